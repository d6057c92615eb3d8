"""The event vocabulary: token ids, special tokens, variable groups, subsystems."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, in order of token id.
EVENTS = [
    "NET_CXI_RAW_DATA", "FS_DISK_FULL", "INFO_NOISE", "NET_CXI_TIMEOUT", "SVC_RSYSLOG_ERR", "NET_CXI_LINK", "FS_DVS_WARN", "NET_CXI_WARN", "NET_TCP_FAIL", "HW_PCIE_ERR",
    "HW_MCE_GENERIC", "NET_CXI_INT_ERR", "HW_MCE_FATAL", "NET_CXI_HW_ECC", "APP_INFRA_FAIL", "NET_CXI_SVC", "GPU_MEM_FAULT", "HW_MCE_CORRECTED", "HW_EDAC_ERR", "FS_CLUSTER_EVICT",
    "FS_LUSTRE_SLOW", "SVC_SYSTEMD_START", "SVC_CONFIG_ERR", "GPU_SOFT_LOCK", "HW_FABRIC_RTR", "NET_CONFIG_ERR", "HW_MEM_DIMM", "SEC_AUTH_FAIL", "GPU_RAS_FAIL", "HW_IOMMU_ERR",
    "FS_LUSTRE_OST_ERR", "APP_FILE_MISSING", "SYS_KERNEL_CTX", "FS_LUSTRE_ERR", "GPU_DRIVER_ERR", "FS_XFS_ERR", "GPU_FIRMWARE", "HW_BMC_WARN", "APP_JOB_CANCEL", "APP_CFG_ERR",
    "HW_ACPI_WARN", "APP_JOB_LATENCY", "NET_CXI_FIRMWARE", "FS_IO_ERR", "NET_CXI_PHY_ERR", "SVC_SYSTEMD_SPEC", "SYS_OOM_KILL", "APP_JOB_CGROUP", "HW_IF_GPU_LINK", "FS_GPFS_ERR",
    "GPU_HARD_FAULT", "HW_USB_FAIL", "HW_MCE_CPU", "SYS_WATCHDOG", "NET_CXI_MGMT_ERR", "FS_LUSTRE_MDS_ERR", "SYS_CONFIG_ERR", "SYS_RCU_STALL", "APP_JOB_ERR", "NET_RPC_ERR",
    "NET_LNET_ERR", "GPU_TIMEOUT", "SYS_SEGFAULT", "SVC_SYSTEMD_TIME", "HW_THERMAL_CRIT", "CTX_LUSTRE", "HW_MCE_DUMP", "HW_MEM_CORRUPT", "STO_NVME_STALL", "SVC_SYSTEMD_EXIT",
    "APP_GITLAB_FAIL", "SVC_SYSTEMD_KILL", "SYS_KERNEL_PANIC", "CTX_AMDGPU", "SYS_COREDUMP", "HW_CPU_CORE", "SYS_PROCESS_LIM", "SYS_X11_NOISE", "SYS_CLOCK_SKEW", "CTX_SCHEDULER",
    "NET_LNET_WARN", "HW_PCIE_HUB", "SVC_SYSTEMD_PAM", "CTX_MEMORY", "CTX_SLINGSHOT", "HW_FABRIC_INT", "HW_MCE_UNK",
]
PAD, UNK, MASK = 87, 88, 89
#: The nine variable groups; their concatenation is the column order of wide matrices.
GROUPS = {
    "GPU": ["GPU_MEM_FAULT", "GPU_SOFT_LOCK", "GPU_RAS_FAIL", "GPU_DRIVER_ERR", "GPU_FIRMWARE", "GPU_HARD_FAULT", "GPU_TIMEOUT", "HW_IF_GPU_LINK"],
    "HW_MCE": ["HW_MCE_GENERIC", "HW_MCE_FATAL", "HW_MCE_CORRECTED", "HW_MCE_CPU", "HW_MCE_DUMP", "HW_MCE_UNK", "HW_MEM_DIMM", "HW_MEM_CORRUPT", "HW_EDAC_ERR", "HW_CPU_CORE"],
    "HW_OTHER": ["HW_PCIE_ERR", "HW_PCIE_HUB", "HW_IOMMU_ERR", "HW_BMC_WARN", "HW_ACPI_WARN", "HW_THERMAL_CRIT", "HW_USB_FAIL", "HW_FABRIC_RTR", "HW_FABRIC_INT"],
    "NET_CXI": ["NET_CXI_RAW_DATA", "NET_CXI_TIMEOUT", "NET_CXI_LINK", "NET_CXI_WARN", "NET_CXI_INT_ERR", "NET_CXI_HW_ECC", "NET_CXI_SVC", "NET_CXI_FIRMWARE", "NET_CXI_PHY_ERR", "NET_CXI_MGMT_ERR"],
    "NET_OTHER": ["NET_TCP_FAIL", "NET_CONFIG_ERR", "NET_RPC_ERR", "NET_LNET_ERR", "NET_LNET_WARN"],
    "FS": ["FS_DISK_FULL", "FS_DVS_WARN", "FS_CLUSTER_EVICT", "FS_LUSTRE_SLOW", "FS_LUSTRE_OST_ERR", "FS_LUSTRE_ERR", "FS_XFS_ERR", "FS_IO_ERR", "FS_GPFS_ERR", "FS_LUSTRE_MDS_ERR", "STO_NVME_STALL"],
    "SYS": ["SYS_KERNEL_CTX", "SYS_OOM_KILL", "SYS_SEGFAULT", "SYS_WATCHDOG", "SYS_CONFIG_ERR", "SYS_RCU_STALL", "SYS_KERNEL_PANIC", "SYS_COREDUMP", "SYS_PROCESS_LIM", "SYS_X11_NOISE", "SYS_CLOCK_SKEW"],
    "SVC_APP": ["SVC_RSYSLOG_ERR", "SVC_SYSTEMD_START", "SVC_CONFIG_ERR", "SVC_SYSTEMD_SPEC", "SVC_SYSTEMD_TIME", "SVC_SYSTEMD_EXIT", "SVC_SYSTEMD_KILL", "SVC_SYSTEMD_PAM", "APP_INFRA_FAIL", "APP_JOB_CANCEL", "APP_CFG_ERR", "APP_JOB_LATENCY", "APP_JOB_CGROUP", "APP_FILE_MISSING", "APP_JOB_ERR", "APP_GITLAB_FAIL"],
    "CTX_SEC": ["INFO_NOISE", "SEC_AUTH_FAIL", "CTX_LUSTRE", "CTX_AMDGPU", "CTX_SCHEDULER", "CTX_MEMORY", "CTX_SLINGSHOT"],
}


@dataclass(frozen=True)
class Vocabulary:
    """Event names and their ids; any list of names can stand in for EVENTS."""

    ids: dict[str, int] = field(default_factory=lambda: {e: i for i, e in enumerate(EVENTS)})
    unknown: int = UNK

    @classmethod
    def of(cls, names: list[str], unknown: int = UNK) -> Vocabulary:
        return cls({e: i for i, e in enumerate(names)}, unknown)

    def token(self, event: Column) -> Column:
        """Id of an event name; unknown and null names get the unknown id. One map literal, no join."""
        known = F.create_map(*[F.lit(x) for kv in self.ids.items() for x in kv])
        return F.coalesce(F.try_element_at(known, event), F.lit(self.unknown)).cast("int")

    def name(self, token: Column) -> Column:
        known = F.create_map(*[F.lit(x) for e, i in self.ids.items() for x in (i, e)])
        return F.try_element_at(known, token.cast("int"))

    def table(self, spark: SparkSession) -> DataFrame:
        """The dimension table (event, token, variable_group); a few dozen rows."""
        of = {e: g for g, es in GROUPS.items() for e in es}
        return spark.createDataFrame([(e, i, of.get(e)) for e, i in self.ids.items()], "event string, token int, variable_group string")


def column_order() -> list[str]:
    """Columns of wide matrices: groups in turn, each event once."""
    return list(dict.fromkeys(e for es in GROUPS.values() for e in es))
