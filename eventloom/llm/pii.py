"""Personal data by weak supervision.

Candidate spans come from four base expressions and from looser ones. On every
candidate of a looser kind three labelers vote (for, against, abstain): the form
of the span, a gazetteer over the span's own text, and the words around it.
Candidates of all documents are counted by kind, votes and features (length,
different characters and digits, in a few steps each). Expectation-maximisation
over that table estimates each labeler's reliability for each kind, and a
logistic span classifier per kind is trained on the estimated labels from votes
and features. The table is bounded by the number of patterns, not by the data.
Candidates that the classifier accepts join the base spans; base spans always
stay.

Positions are code points, end exclusive. A text is cut at the matches of an
expression; running lengths of the pieces give the places, so no Python code
and no shuffle is needed for them. Texts are looked at once: candidates are
written to the shared folder, for training and detection alike.

Defined results: null text counts as empty; of matches that fail their check
nothing is tried again; an empty table trains nothing and accepts nothing;
repeated rows vote once each; extra columns are ignored; very long texts are
matched whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut

#: Base kinds in the order that breaks ties. Atoms and possessive repeats keep
#: matching linear and free of recursion; they match what the plain forms match,
#: since what follows each repeat cannot start inside it.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser kinds: secrets (long hexadecimal numbers, keys with a vendor's prefix, and what is assigned to a word for one), national numbers by their grouping, account numbers by country prefix, and people by title.
LOOSE = {
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|ghs|glpat|xox[abp]|sk|pk|rk|hf)[_-][A-Za-z0-9_-]{16,96}|eyJ[A-Za-z0-9_-]{16,2000}(?:\.[A-Za-z0-9_-]{8,2000}){1,2}|(?<=(?:(?i:token|secret|password|passwd|pwd|key))[\x22']?\x20{0,2}[:=]\x20{0,2}[\x22']?)[A-Za-z0-9_+/.!@#%^&-]{8,96})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-Z][A-Za-z'-]+(?:\x20[A-Z][A-Za-z'-]+)?",
}
KINDS = [*BASE, *LOOSE]
#: Gazetteers: what a span must not be, or must be, by its own text.
IBAN_COUNTRIES = ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
SECRET_PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "sk_", "sk-", "pk_", "rk_", "hf_", "eyJ"]
GIVEN_NAMES = ["Ada", "Alan", "Anna", "Carlos", "Clara", "David", "Elena", "Emma", "Hans", "Ines", "Jean", "John", "Jose", "Karl", "Laura", "Maria", "Marie", "Mary", "Paul", "Peter", "Sofia", "Thomas"]
#: Words that speak for a kind when they stand within CONTEXT characters before a span.
CONTEXT = 40
CUES = {
    "secret": r"(?i)(?:token|secret|password|passwd|api.?key|key|auth)\W*$",
    "ssn": r"(?i)(?:ssn|social security|tax id)\W*$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta)\W*$",
    "person": r"(?i)(?:name|called|contact|by|von|par|por|dear)\W*$",
}
LABELERS = ("form", "gazetteer", "context")
ROUNDS, ACCEPT = 50, 0.5


def places(text: str, pattern: str) -> Column:
    """Array of (s, e, m, before): every match of ``pattern`` with its place and up to CONTEXT characters before it."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(
        f"aggregate(zip_with(split({text}, '{p}', -1), regexp_extract_all({text}, '{p}', 0), (g, m) -> struct(g AS g, m AS m)), "
        "struct(0 AS at, CAST(array() AS array<struct<s:int,e:int,m:string,before:string>>) AS found), "
        "(a, x) -> CASE WHEN x.m IS NULL THEN a ELSE struct(a.at + length(x.g) + length(x.m) AS at, "
        f"array_append(a.found, struct(a.at + length(x.g) AS s, a.at + length(x.g) + length(x.m) AS e, x.m AS m, right(x.g, {CONTEXT}) AS before)) AS found) END, a -> a.found)"
    )


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


#: Checks of the base kinds, as SQL over the matched text m.
CHECKS = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND CAST(concat('0', right(ltrim('0', p), 3)) AS int) <= 255)",
    "card": f"length({_digits('m')}) BETWEEN 12 AND 19 AND luhn_check({_digits('m')})",
    "phone": f"length({_digits('m')}) BETWEEN 9 AND 15",
}


def _checked(kind: str, column: str) -> Column:
    body = CHECKS[kind].replace("(m,", "(x.m,")
    return F.expr(f"filter({column}, x -> {body})")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, p_text, one array of checked matches per kind."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("p_text"))
    cols = {}
    for kind, pattern in (BASE | LOOSE).items():
        # a cheap look first: most texts have no match of most kinds
        none = F.array().cast("array<struct<s:int,e:int,m:string,before:string>>")
        look = {"email": F.col("p_text").contains("@"), "phone": F.col("p_text").contains("+")}.get(kind, F.lit(True)) & F.col("p_text").rlike(pattern.replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "(?<![A-Za-z0-9._%+-])"))
        cols["c_" + kind] = F.when(look, places("p_text", pattern)).otherwise(none)
    df = df.select("doc_id", *[c.alias(n) for n, c in cols.items()])
    return df.withColumns({"c_" + k: _checked(k, "c_" + k) for k in BASE})


def _votes(kind: str) -> str:
    """Votes of the three labelers on a loose candidate x: 1 for, -1 against, 0 abstain."""
    m = "x.m"
    form = {
        "secret": f"CASE WHEN {m} rlike '[0-9]' AND {m} rlike '[A-Za-z]' THEN 1 ELSE -1 END",
        "ssn": f"CASE WHEN left({m}, 3) IN ('000', '666') OR left({m}, 1) = '9' OR substr({m}, 5, 2) = '00' OR right({m}, 4) = '0000' THEN -1 ELSE 1 END",
        "iban": f"CASE WHEN aggregate(split(concat(substr({m}, 5), left({m}, 4)), ''), 0, (a, ch) -> CASE WHEN ch BETWEEN '0' AND '9' THEN (a * 10 + CAST(ch AS int)) % 97 ELSE (a * 100 + ascii(ch) - 55) % 97 END) = 1 THEN 1 ELSE -1 END",
        "person": f"CASE WHEN length({m}) BETWEEN 6 AND 40 THEN 1 ELSE -1 END",
    }[kind]
    names = ", ".join(f"'{n}'" for n in GIVEN_NAMES)
    listed = {
        "secret": f"CASE WHEN size(array_distinct(split({m}, ''))) < 6 THEN -1 WHEN {m} rlike '^(?:{'|'.join(SECRET_PREFIXES)})' THEN 1 ELSE 0 END",
        "ssn": f"CASE WHEN {m} IN ('078-05-1120', '123-45-6789') THEN -1 ELSE 0 END",
        "iban": "CASE WHEN left(x.m, 2) IN (" + ", ".join(f"'{c}'" for c in IBAN_COUNTRIES) + ") THEN 1 ELSE -1 END",
        "person": f"CASE WHEN arrays_overlap(split({m}, '[ .]+'), array({names})) THEN 1 ELSE 0 END",
    }[kind]
    cue = CUES[kind].replace("\\", "\\\\")
    return f"array({form}, {listed}, CASE WHEN x.before rlike '{cue}' THEN 1 ELSE -1 END)"


#: Steps of each feature: length by eights, different characters and digits by thirds of the length.
FEATURES = {"long": ("least(CAST(length(x.m) / 8 AS int), 7)", 7), "mixed": ("CAST(3 * size(array_distinct(split(x.m, ''))) / length(x.m) AS int)", 3), "digits": ("CAST(3 * length(regexp_replace(x.m, '[^0-9]', '')) / length(x.m) AS int)", 3)}


@dataclass
class Labeling:
    """What training leaves for a kind: the prior, reliabilities by labeler, and the classifier's weights (bias, votes, features)."""

    prior: float
    reliability: dict[str, float]
    weights: list[float]

    def score(self, votes, features=(0.0, 0.0, 0.0)) -> float:
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], (*votes, *features), strict=True))
        return 1 / (1 + math.exp(-z))


def train(patterns: list[tuple]) -> Labeling:
    """Expectation-maximisation over counted patterns (votes, count[, features]), then a logistic fit to the estimated labels.

    A labeler that does not abstain is right with its reliability. The table has
    a row for each pattern of votes and feature steps at most, however many
    candidates there are.
    """
    rows = [(v, n, f[0] if f else (0.0,) * len(FEATURES)) for v, n, *f in patterns]
    prior, rel = 0.5, [0.8] * len(LABELERS)
    total = sum(n for _, n, _ in rows)
    if not total:
        return Labeling(prior, dict(zip(LABELERS, rel, strict=True)), [0.0] * (len(LABELERS) + len(FEATURES) + 1))

    def posterior(votes) -> float:
        yes, no = math.log(prior), math.log(1 - prior)
        for r, v in zip(rel, votes, strict=True):
            if v:
                yes += math.log(r if v > 0 else 1 - r)
                no += math.log(r if v < 0 else 1 - r)
        return 1 / (1 + math.exp(min(50.0, max(-50.0, no - yes))))

    for _ in range(ROUNDS):
        post = {v: posterior(v) for v, _, _ in rows}
        prior = min(0.95, max(0.05, (sum(post[v] * n for v, n, _ in rows) + 1) / (total + 2)))
        for j in range(len(rel)):
            cast = sum(n for v, n, _ in rows if v[j])
            right = sum((post[v] if v[j] > 0 else 1 - post[v]) * n for v, n, _ in rows if v[j])
            rel[j] = min(0.99, max(0.55, (right + 4) / (cast + 5)))  # labelers are taken to do better than chance
    x = np.array([(1, *v, *f) for v, _, f in rows], float)
    y, n = np.array([posterior(v) for v, _, _ in rows]), np.array([n for _, n, _ in rows], float) / total
    weights = np.zeros(x.shape[1])
    for _ in range(1000):
        weights += 0.5 * (x.T @ (n * (y - 1 / (1 + np.exp(-x @ weights))))) - 0.0005 * weights
    return Labeling(prior, dict(zip(LABELERS, rel, strict=True)), [float(w) for w in weights])


def _voted(found: DataFrame) -> DataFrame:
    """doc_id, the base kinds' places, and the looser candidates with their votes and features."""
    features = "array(" + ", ".join(f"{e} / {n}D" for e, n in FEATURES.values()) + ")"
    loose = [f"transform(c_{k}, x -> struct('{k}' AS kind, x.s AS s, x.e AS e, {_votes(k)} AS votes, {features} AS features))" for k in LOOSE]
    return found.select("doc_id", *[F.transform(f"c_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(f"c_{k}") for k in BASE], F.expr(f"concat({', '.join(loose)})").alias("voted"))


def learn(voted: DataFrame) -> dict[str, Labeling]:
    """Counts the patterns of all candidates and trains a model for each looser kind."""
    rows = voted.select(F.explode("voted").alias("v")).groupBy("v.kind", "v.votes", "v.features").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by kinds, votes and steps
    return {k: train(sorted((tuple(r.votes), r.n, tuple(r.features)) for r in rows if r.kind == k)) for k in LOOSE}


def detect(voted: DataFrame, models: dict[str, Labeling]) -> DataFrame:
    """doc_id, counts of the base kinds, base and all as sorted arrays of (s, k, e, kind)."""
    span = lambda k, kind: f"transform(c_{kind}, x -> struct(x.s AS s, {k} AS k, x.e AS e, '{kind}' AS kind))"
    base = F.expr(f"array_sort(concat({', '.join(span(i, k) for i, k in enumerate(BASE))}))")
    order = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {KINDS.index(k)}" for k in LOOSE) + " END"
    n = len(LABELERS)
    z = {k: f"{m.weights[0]!r}D" + "".join(f" + {w!r}D * x.{'votes' if j < n else 'features'}[{j if j < n else j - n}]" for j, w in enumerate(m.weights[1:])) for k, m in models.items()}
    sure = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN 1 / (1 + exp(-({e})))" for k, e in z.items()) + " END"
    taken = F.expr(f"transform(filter(voted, x -> {sure} > {ACCEPT}D), x -> struct(x.s AS s, {order} AS k, x.e AS e, x.kind AS kind))")
    df = voted.withColumn("base", base).withColumn("added", taken)
    return df.select("doc_id", *[F.size(f"c_{k}").cast("long").alias(f"n_{k}") for k in BASE], "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def _listed(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns, and how many spans there are of any kind."""
    voted = cut(_voted(candidates(docs)))
    out = detect(voted, learn(voted))
    return out.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
