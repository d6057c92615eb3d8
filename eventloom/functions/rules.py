"""The ordered rule base: first match wins, so order is priority."""

from __future__ import annotations

#: Label, pattern, and whether letter case is ignored.
RULES: list[tuple[str, str, bool]] = [
    ("NET_CXI_HW_ECC", r"(?:cxi_ss1|cxi_core|device hsn\d+|pnp 00:\d+).* (?:C_EC_UNCOR|C_EC_CRIT|C_EC_UNCOR_NS|C_EC_BADCON_S)|Fatal error", False),
    ("NET_CXI_MGMT_ERR", r"(?:cxi_ss1|cxi_core|device hsn\d+|hsn\d+|ens\d+|sbl|cxi_sbl).* (?:Unexpected PLDM completion|failed to bring up device|Decoupling failed|unable to apply configuration|Failed to read setting!)", False),
    ("NET_CXI_PHY_ERR", r"(?:cxi_ss1|cxi_core|sbl|cxi_sbl).* (?:PCIe error:.*(?:TX Nak|RX Nak|LCRC Error|BAD TLP|RX Recovery|Replay Timer|Retry LLP|Replay Timeout|BAD DLLP)|max llr replay|pml hdlr|ucw fail|bad ucw|Failed CRC check)", True),
    ("NET_CXI_LINK", r"(?:(?:warning:|error:)\s*)?(?:cxi_ss1|cxi_core|\[ID \d+\]|sbl|cxi_sbl|hsn\d+).* (?:Carrier lost|link down alert|unexpected disconnect|auto lane degrade|PCS lock|pcs lock|alignment lost|alignment failed|Unable to set state up|some eyes have gone bad|serdes_.* failed|SerDes .* failed|LLR .* failed|LLR .* timeout|pcs_wait .* timeout|errors already present|pml_start failed|sbl_serdes_op failed|link fault detect start failed|link failed during startup|exchange timeout)|high BER port|determined to be down|CXI_EVENT_LINK_UP|CXI_EVENT_LINK_DOWN|lmon: up request failed|rx degrade failure alert|Inbound wait is stuck|Inbound wait timeout|Operstate or carrier state down|sbl_link_down failed", False),
    ("NET_CXI_INT_ERR", r"(?:cxi_ss1|cxi_core|kfi_cxi|kcxi_\w+|kcxi_md_alloc|kcxi_md_cache_remove_md|kcxi_msg_tx_req_cb|kcxi_sendmsg|kfi_cxi - .* Failed to match).* (?:uC failed to return|OXE_AT_EPOCH_CNTR|cxi_user_pte_status|ucxi_write|couldn't read page|No VMA covering|Failed to map|Failed to update IOV|freeing cached md|Failed to allocate|Failed to match with local)", True),
    ("NET_CXI_WARN", r"(?:cxi_ss1|cxi_core|sbl|cxi_sbl|kfi_cxi).* (?:C_EC_COR|C_EC_BADCON|port_dfa_mismatch|lmon: warning|warning, ccw|out of bounds|tuning params bad|Unable to get AMA|not AMA format)|retried due to timeouts|nack_backoff|sct_.*_epoch|reset_inflight_ordered|Unable to get AMA", False),
    ("NET_CXI_SVC", r"(?:(?:error:)\s*)?(?:mlx5_core|cxi_core).* (?:CXI allocation failed|Slingshot service allocation failed|No TLE pools|Failed to destroy CXI Service|give fail|failed to allocate page)|No TLE pools available|CXI allocation failed for|Failed to destroy CXI Service", False),
    ("NET_CXI_FIRMWARE", r"(?:cxi_sbl|sbl|cxi_core|firmware|cxi_ss1).* (?:multiple software versions|kfi_cxi|kdreg2|Image was not found|DRV_MSG_CODE|serdes fw loaded|failed to read the cable eeprom)", False),
    ("NET_CXI_RAW_DATA", r"^(?:Tracking|PCT|sct=|retrying|retry completed|force closing|will close|cancel completed|now cancelling|CXI retry).* (?:sct=|tct=|nid=|cxi_retry|PCT |SPT chain|because it only saw|scheduled retry)", True),
    ("NET_CXI_TIMEOUT", r"(?:cxi_core|cxi_ss1|kfi_cxi|kcxi_\w+|PCT).* (?:SCT|TCT|FC Timeout|Message timeout|sct|tct|taking longer than)|(?:now cancelling|will close|force closing|force close|cancel completed).* (?:SCT|TCT|sct|tct|because it only saw)", True),
    ("GPU_RAS_FAIL", r"(?:amdgpu|\[?drm|kfd).* (?:RAS records|Fatal error during GPU init|RAS init harvest failure|Saved bad pages|EEPROM failed|EEPROM table records error|amdgpu_ras_eeprom|Failed to save .* data|Writing .* records error|due to bad_page_threshold)", False),
    ("GPU_MEM_FAULT", r"(?:amdgpu|\[?drm|kfd).* (?:retry page fault|no-retry page fault|VM_L2_PROTECTION_FAULT|Failed to map bo to gpuvm|init_user_pages: Failed|WALKER_ERROR|PERMISSION_FAULTS|MAPPING_ERROR|MORE_FAULTS|Faulty UTCL2|in page starting at|RW:|for process .* pid|already allocated by SVM|userq sem|still active bo|Didn't find vmid)", False),
    ("GPU_SOFT_LOCK", r"(?:amdgpu|\[?drm|kfd).* (?:Runlist is getting oversubscribed|No more .* queue|DQM create queue.*failed|Queues reset on process|queue id .* is reset)", False),
    ("GPU_HARD_FAULT", r"(?:amdgpu|\[?drm|kfd).* (?:unrecoverable state|Fence fallback timer|ih_fifo overflow|ih ring buffer overflow|IH soft ring buffer overflow|IH ring buffer overflow|GCEA err detected|MMHUB EA err detected|sq_intr: error|failed to write reg)", False),
    ("GPU_FIRMWARE", r"(?:amdgpu|\[?drm|kfd).* (?:firmware version too old|Failed to import|Failed to quiesce|Unable to find adev|failed to load ucode|Board power calibration failed|amdgpu_device_ip_init failed|probe of .* failed|hw_init of IP block .* failed)", False),
    ("GPU_TIMEOUT", r"(?:amdgpu|\[?drm|kfd).* (?:timeout waiting for .* fence|stall on|VM flush ACK|SMU: I'm not done|ring .* timeout|fence wait loop timeout)", False),
    ("GPU_DRIVER_ERR", r"(?:amdgpu|\[?drm|kfd).* (?:amdgpu_irq_put|Failed to|PCI INT A: not connected|No irq handler|failed to validate PT BOs|Freeing queue vital buffer|Failed to allocate process doorbells|failed to allocate kernel bo|psp gfx command INVOKE_CMD.*failed|\[TTM\]|Illegal opcode|amdgpu_vm_bo_update|update_gpuvm_pte|failed to resume KFD|Queue preemption failed|psp gfx command .* failed|GPU Recovery Failed|reset failed!|Bug: No PASID|failed to load driver|resume of IP block .* failed|Resetting wave fronts)|\[drm:.*\] \*ERROR\*|failed to load driver: \w+|Bug: No .* in .*|MESA: error|ZINK:|VK_ERROR_", False),
    ("HW_MCE_FATAL", r"mce: Uncorrected hardware memory error|Fatal Machine Check|Machine Check:|\[Hardware Error\]: (IPID|PPIN|System Hub|Unified Memory|TSC)|Uncorrected, software restartable|Hardware error from APEI Generic", False),
    ("HW_MCE_CPU", r"mce: \[Hardware Error\]: PROCESSOR|mce: Unexpected threshold interrupt", False),
    ("HW_MCE_DUMP", r"IPID |PPIN |SYND |MISC |\|SyndV\||\|CECC\||\|UECC\||\|UECC|\|Deferred\||\|Scrub\||\|Scrub\]|ADDR [0-9a-f]+|\]: 0x[0-9a-f]+|\|-\|-\|-\]:|Syndrome:|\|SyndV", False),
    ("HW_MCE_GENERIC", r"\[Hardware Error\]: (?:Error|L3 Cache|Coherent Slave|Ext Global Memory|Load Store Unit|Power, Interrupts)(?:.*) (?:Addr|Misc|Ext\. Error Code)|internal: RESV|cache level:|MCE records pool full|APEI Generic|LSI_IDLE_CHECK|too many record IDs|ERST|failed \(load will be required", False),
    ("HW_MCE_CORRECTED", r"\[Hardware Error\]: Corrected error|\[Hardware Error\]: Deferred error", False),
    ("HW_EDAC_ERR", r"EDAC MC\d+|EDAC .* (UE|CE) on|UE Cannot decode|CE Cannot decode|Cannot decode normalized address|edac_mc_handle_error|edac_raw_mc_handle_error", False),
    ("HW_IOMMU_ERR", r"AMD-Vi: Event logged|INVALID_DEVICE_REQUEST|IOMMU_FAULT|Inconsistent EFR|Found inconsistent EFR|EFR mismatch|AMD-Vi: Completion-Wait loop timed out", False),
    ("HW_MEM_CORRUPT", r"Memory failure:.*Sending SIGBUS|unhandlable page|hardware memory corruption|page_counter underflow|shrink_folio_list|generic_error_remove_page|hmm_range_fault|Send SIGBUS to process|recovery action for dirty LRU page", False),
    ("HW_PCIE_ERR", r"PCIe (?:Bus|AER) (?:Error|not enabled)|PCIe link lost|DPC: (ERR_FATAL|unmasked uncorrectable)|L0 to Recovery|not connected|Unknown NUMA node|can't derive routing|PCI INT A: no GSI|pcieport.*RxErr|device.*error status/mask|BadTLP|AER: Error of this Agent|NonFatalErr|RxErr|BadDLLP|Rollover|Timeout|RX Recovery Request|failed to enable I/O ports|AER:\s+Error|pci .* can't derive routing|SDES", False),
    ("HW_USB_FAIL", r"usb .*: (?:Cannot enable|unable to enumerate)|i8042: (?:probe of .* failed|Can't aux|.* failed|Can't read .* while initializing)", False),
    ("HW_ACPI_WARN", r"ACPI (Warning|AML tables)|Invalid PCCT", False),
    ("HW_BMC_WARN", r"ipmi_si.*BMC does not support|Failed to execute ipmitool|hpilo.*Open could not dequeue|Couldn't read the IPMI|command failed: BMC initialization", False),
    ("HW_THERMAL_CRIT", r"temperature.*exceeds warning threshold|thermal throttling|THERMAL_FAULT|sensor .* in (fatal|critical|warning) state", False),
    ("FS_CLUSTER_EVICT", r"LustreError:.*(evicted|Evicted|Lost membership|unmounting file system)|\[E\] Lost membership|\[E\] Remount failed|Unable to contact any quorum nodes|Failed unmounting|Lustre: Evicted|Lustre: Unmounted|Connection to .* was lost|DVS: No valid nodes|Close connection to .* Node failed", False),
    ("FS_LUSTRE_SLOW", r"(?:LustreError:|Lustre:).* (?:timed out|slow reply|sluggish|lock timed out|Network is sluggish|Request sent has timed out)|connected to the broker .* but haven't received|rpc_clnt_ping_timer_expired", False),
    ("FS_LUSTRE_MDS_ERR", r"LustreError:.*(MDC|mdc|MDS|mds|refresh file layout|lookup|namespace|can't stat MDS)|no group lock held", False),
    ("FS_LUSTRE_OST_ERR", r"LustreError:.*(OSC|osc|OST|ost|object|extent|page discard|recovery action)|dirty page discard|resending request on EINPROGRESS|import=connection", False),
    ("FS_LUSTRE_ERR", r"LustreError:|Lustre: .* (?:mount|recovery|connect|setup|initialize|Request sent has) failed|VFS: Lookup of .* caused loop|File System .* unmounted by the system|page is under heavy contention", False),
    ("FS_GPFS_ERR", r"Error=MMFS_PHOENIX|\[X\] Recovery Log I/O failed|\[W\] GPFS detected .* vCPUs|\[W\] The TCP connection .* unexpected|\[E\] Failed to join|\[E\] Failed to open|Command: err .* mount|Error=MMFS_SYSTEM_UNMOUNT|Unrecoverable file system operation|expelled from the cluster|Error=MMFS_DISKFAIL|\[E\] Disk failure|Could not open the key store file|The RKM is in quarantine|TCP connection with the RKM|Freeing shared GPFS trace buffer|key server .* quarantined|Key .* could not be fetched|A severe error was encountered during cluster probe|Disk free space collection .* aborting", False),
    ("FS_XFS_ERR", r"XFS .* metadata I/O error|xfs filesystem being mounted", False),
    ("FS_DISK_FULL", r"No space left on device|write error .* No space left|Region database full|SEL buffer used at \d+|no space left on logging partition|Disk quota exceeded", False),
    ("FS_IO_ERR", r"Input/output error|SQUASHFS error|Failed to read block|kernel resource error|Read-only file system|iSCSI Login negotiation failed|Device: /dev/sd.* \[SAT\]|Offline uncorrectable sectors|journal corrupted|I/O Cmd.*I/O Error|Admin Cmd.*I/O Error|I/O error, dev .*|overlayfs: failed to|overlayfs: .* in-use|Stale file handle|VG .* incomplete|PV .* has no VG metadata|PV .* is duplicate for PVID", False),
    ("STO_NVME_STALL", r"nvme.*taking a long time|nvme.*frozen state|nvme.*reset controller|Worker.*processing SEQNUM|Worker .* terminated by signal|Device: .*, Critical Warning", False),
    ("FS_DVS_WARN", r"DVS: .* failed|DVS: .* error|DVS: .* timeout|WARNING: dvs.* is down|WARNING: dvs.* is up|killing request RQ_FILE|DVS debugfs|read_clustered_super|cray-dvs-mqtt|DVS: common_retry|loadbalance_index|marking it down|from downed node|All replies .* stuck|No sign of dvs.* after reconnect", False),
    ("SYS_OOM_KILL", r"Out of memory: (Killed|Setting TIF_MEMDIE)|invoked oom-killer|page allocation failure: order:|SLUB: Unable to allocate|VM_FAULT_OOM|Cannot allocate memory|slab_out_of_memory|pagefault_out_of_memory|rtnetlink .* Out of memory", False),
    ("SYS_SEGFAULT", r"segfault at .* ip |kernel trap in|General Protection Fault at|RIP: [0-9a-f]+:[0-9a-f]+|traps: .* general protection|traps: .* trap invalid opcode", False),
    ("SYS_KERNEL_PANIC", r"Kernel panic|BUG: (?:soft|hard|spinlock) lockup|unable to handle kernel|No irq handler for vector|DVS: .* is NULL!", False),
    ("CTX_AMDGPU", r"(?:Call Trace:|RIP:).*?(?:amdgpu_|kfd_|drm_|ttm_|atom_)", True),
    ("CTX_LUSTRE", r"(?:Call Trace:|RIP:).*?(?:ptlrpc|lustre|ldlm|obd_|lnet_)", True),
    ("CTX_SLINGSHOT", r"(?:Call Trace:|RIP:).*?(?:cxi_|kfi_|ss_core)", True),
    ("CTX_MEMORY", r"(?:Call Trace:|RIP:).*?(?:mm_|slab_|alloc_pages|kmem_cache|vmalloc|page_fault)", True),
    ("CTX_SCHEDULER", r"(?:Call Trace:|RIP:).*?(?:schedule|pick_next_task|rcu_|spin_lock|mutex_lock)", True),
    ("SYS_KERNEL_CTX", r"(?:R(?:1[0-5]|0?[0-9]): |RBP: |RSP: |FS: |GS: |EFLAGS: |ORIG_RAX: |Modules linked in: [\w_]+|CPU: \d+ PID:|CS: .* DS: .*|RAX: |CR2: |<TASK>|</TASK>|<IRQ>|</IRQ>|RDX: |RSI: |-{4,}\[ (?:cut here|end trace) \]-{4,}|[\w_]+\+0x[0-9a-f]+/[0-9a-f]+|RIP: [0-9a-f]+:[0-9a-f]+|Call Trace:|(?:[\w_]+\([A-Z]+\)\s+)+[\w_]+\([A-Z]+\)|Code: (?:[0-9a-f]{2}\s+){2,}[0-9a-f]{2}|rcu: Stack dump where .*|rcu: CPU \d+: RCU dump cpu stacks)", False),
    ("SYS_RCU_STALL", r"rcu_.*self-detected stall|rcu_sched kthread starved|blocking rcu_node structures|tasks blocking .* RCU grace period|detected expedited stalls on CPUs|rcu: \s*\d+[-.!:]+ \(\d+ (?:GPs behind|ticks this GP)\)", False),
    ("SYS_WATCHDOG", r"NETDEV WATCHDOG|NMI watchdog: BUG|watchdog: BUG: soft lockup|watchdog: BUG: hard lockup|terminated by own WATCHDOG|watchdog did not stop|watchdog on CPU|Child .* terminated by own WATCHDOG|Failed to send WATCHDOG=.* notification message|NMI backtrace for cpu", False),
    ("SYS_CLOCK_SKEW", r"clocksource: (?:Long readout|Switched to|timekeeping watchdog|Marking clocksource)|Checking clocksource tsc synchronization|chronyd.*(?:Forward time jump|System clock wrong)|ntpd.*(?:System clock wrong|time reset)|Forward time .* jump detected|System clock wrong by|Ring buffer clock went backwards", False),
    ("SYS_CONFIG_ERR", r"sysctl: .* cannot be set|amd_hsmp: Family.*not supported|request_module: kmod_concurrent_max|pstore: ignoring unexpected backend|modprobe: FATAL:|modules\.dep.*No such file|Speculative Return Stack Overflow:.*microcode not applied", False),
    ("SYS_PROCESS_LIM", r"over core_pipe_limit", False),
    ("SYS_COREDUMP", r"systemd-coredump|Skipping core dump|Failed to send coredump|systemd-coredump\.socket: Too many incoming connections", False),
    ("SVC_SYSTEMD_START", r"(?:systemd\[\d+\]|[\w.-]+\.(?:service|mount|scope)): (?:Failed to start|Unit .* entered failed state|.* Dependency failed|Failed with result|Start request repeated(?: too quickly)?)", False),
    ("SVC_SYSTEMD_TIME", r"(?:systemd\[\d+\]|[\w.-]+\.(?:service|mount|scope)): .* timed out|call to .* failed: DBus method call timed out|Failed to activate service '.*': timed out", False),
    ("SVC_SYSTEMD_EXIT", r"[\w.-]+\.(?:service|mount|scope): (?:Main process exited|Mount process exited|Control process exited|Failed with result)", False),
    ("SVC_SYSTEMD_KILL", r"(?:Mount|Main|Control) process still around after SIGKILL|Processes still around after SIGKILL", False),
    ("SVC_SYSTEMD_PAM", r"pam_systemd\(\S+\): Failed to (?:stat.*runtime directory|create session|release session)", False),
    ("SVC_SYSTEMD_SPEC", r"Failed to start (?:Ipmievd Daemon|Rotate log files|User Manager for UID|Rule-based Manager|CM Configuration|k3s|Cluster Manager|Kafka Message Processor|Session \d+ of User|Cray Parallel Application Launch Service Daemon)", False),
    ("APP_GITLAB_FAIL", r"(?:ERROR: Job failed|Checking for jobs\.\.\. failed|failed to authorize user|invalid authorization target|Job was canceled|ERROR: after_script failed|Error encountered during job|Error executing run_exec|RunAs message|Failed to process runner|get_sources could not run|script canceled externally \(UI, API\)|Error executing [\w_-]+: exit status \d+|WARNING: Job failed: exit status|Job failed: execution took longer than)", False),
    ("APP_FILE_MISSING", r"(?:grep:|execve\(\):|open:|stat:|python:|cat:|rm:|ls:|mv:|cp:|head:|tail:|sort:|bash:|sh:|sudo:).*No such file|cannot open shared object file|Could not initialize handlers|Opening file .* failed|Could not open stdout file|unable to open (?:/[a-zA-Z0-9]+|.*No such file)|Failed to open (?:/[a-zA-Z0-9]+|.*No such file|.*directory)|Error opening directory", False),
    ("APP_CFG_ERR", r"(?:grep:|execve\(\):|bind:|bash:|sh:|sudo:|chmod:|chown:|python:).*(?:Permission denied|Access denied|Not a directory|Text file busy)|command not allowed|incorrect password|execve\(\): .* failed|launched .* with NULL argv|started with executable stack|Failed to get current user|Bind request .* does not specify|Exec format error|execve\(\): .* Exec format error|FATAL: .* change permissions failed|CPU binding outside|ERROR chdir failed|Running with local config file despite|Skipping.*because of failed dependencies|Failed to generate additional resources|error: couldn't chdir to", False),
    ("APP_INFRA_FAIL", r"job_manager: exiting abnormally|slurmstepd.*startup took|slurm_send_node_msg.*failed|Slurmd could not connect IO|epilog failed|no task list created|Zero Bytes were transmitted|Job .* already killed|called without a previous step|Slurmd could not connect IO|_rpc_launch_tasks|connect_to .* failed|switch_g_job_postfini|prolog failed|STEPD TERMINATED|Submitting job to coordinator|job failed|INTERACTIVE STEP|Job trace termination|Job failed \(system failure\)|Unable to receive \"ok ack\"|bad node index|stepd_completion|Preparation failed|failed sending step completion|WIFSTOPPED|stat_jobacct|Header lengths are longer than|called without a previous init|Couldn't sent slurm_io_init_msg|failed to get link speed|STEP .* FAILED|no cmds found|No executable program specified|Failed mpi_|no command for task id|Failed to kill program|Prolog failure|XALT_EXCEPTION|epilog: timeout|fatal: _handle_connection|RH: fatal error|Not enough .* to bind|ssh_msg_send failed|slurmstepd:.*Process .* failed with exit code|Failed to send RESPONSE_LAUNCH_TASKS|_forward_thread: failed to|says my messages were dropped|Failed to start Apache Kafka|Failed to start .* for Apache Kafka|rdkafka.* request\(s\) timed out|Failed to send MESSAGE_TASK_EXIT|slurm_receive_resp_msgs.*Socket timed out|stepd_connect to StepId.*failed", False),
    ("APP_JOB_CANCEL", r"CANCELLED AT|EXTERN STEP.*TERMINATED|DUE TO TIME LIMIT|RaisedSignal|killed by signal 15", False),
    ("APP_JOB_ERR", r"kill.*No such process|Process '.*' failed with exit code|Main process exited, code=|Error while executing .* script error=", False),
    ("APP_JOB_CGROUP", r"cgroup plugin has.*processes|can't add pid.*to jobacct_gather|unable to read .* cgroup|Failed to add PIDs to .* control group|_cgroup_procs_check: failed|common_file_write_uints: write value .* failed|slurmstepd:.*Unable to move pid|(?:error:|slurmstepd:.*) Unable to move pid", False),
    ("APP_JOB_LATENCY", r"slurmstepd startup took|steps did not complete quickly|Zero Bytes were transmitted", False),
    ("NET_TCP_FAIL", r"(?:cannot connect|connect to|send_launch|connect io|dial tcp|Connection to).*Connection refused|FAIL: .* disconnect|Connection reset by peer|Broken pipe|No route to host|Network is unreachable|Transport endpoint is not connected|Net::OpenTimeout|bond0: Could not generate persistent MAC|unable to connect to broker|Name or service not known|Bad TCP state detected|Temporary failure in name resolution|Unexpected failure.*Connection refused|\[E\] Connection from .* timed out", False),
    ("SVC_RSYSLOG_ERR", r"rsyslogd: .* action '.*' suspended|action '.*' suspended \(module '.*'\)|(?:rsyslogd: .*|action '.*' .*) message lost|Stopping 'rsyslog.service'|rsyslogd: .* Framing Error|rsyslogd: .* no working or state file directory|imjournal: .*|rsyslogd: .* cannot resolve hostname|rsyslogd: .* Error in publish_message|rsyslogd: .* \$WorkDirectory: .* can not be accessed|cannot resolve hostname '[\w.-]+': Resource temporarily unavailable|Framing Error in received TCP message", False),
    ("SEC_AUTH_FAIL", r"Authentication failure|Invalid credential|PAM: .* failure|Could not start TLS|LDAP connection error|Munge decode failed|Expired credential|unpermitted request|Invalid authentication credential|Protocol major versions differ|userauth_|PAM: User not known|pam_.*:.*failed|pam_unix|Invalid job credential|If munged is up|Disconnecting authenticating user|Protocol authentication error|Proposer's value list|maximum authentication attempts|Munge encode failed|MESSAGE_TASK_EXIT has authentication error|User account has expired|failed decode|kex_protocol_error|PAM adding faulty module|sbcast credential expired|banner line contains invalid|kex_exchange_identification|Failed to set up PAM|Failed at step PAM|Cannot determine the user's name|refused, authentication failed|NOT in sudoers|corruption detected in|error: type \d+ seq|fatal: Access denied .* PAM", False),
    ("SVC_CONFIG_ERR", r"unable to open config|Failed to apply catalog|Failed to fork off|Compatibility logic is deprecated|lacks a native systemd unit|Please update package|\(Facter\) error|Referenced but unset environment variable|marked world-inaccessible|Execution of .* returned|change from .* to .* failed|exceeds the number of facts limit|Duplicate entry in|configuration issue|unrecognized key\(s\) detected|marked executable|Could not evaluate|Skipping .* because of failed dependencies|Couldn't write .* ignoring|attribute has been deprecated|assigned as slingshot", False),
    ("NET_LNET_ERR", r"(?:LNetError:|LNet:).* (?:failed|transport init failed|Discovery failed|unexpected network error|Failed to allocate|Error .* reading HELLO|starting up LNI|total bytes allocated|out of memory|Unexpected error|Failed to get)|Failed to start lnet", True),
    ("NET_LNET_WARN", r"LNet: Ignoring interface|LNet: Host .* reset|lnet: Ignoring interface|\w+\(OE\)|Warning: No 802\.3ad response", False),
    ("NET_RPC_ERR", r"Failed to create listener|Unexpected disconnect|Malformed RPC|Protocol major versions differ|channel .* protocol error", False),
    ("NET_CONFIG_ERR", r"Address family not supported|Binding to IPv6|Invalid priority|DHCPDISCOVER|Multiple interfaces match|bond0.*speed changed", False),
    ("SYS_X11_NOISE", r"(?:^|[\"'])\((?:II|==|--|\+\+|WW|\*\*)\) |Module class: X\.Org|X\.Org Video Driver|X\.Org XInput driver|X Protocol Version|using VT number|modeset\(\d+\):|systemd-logind:|config/udev:|GLX: Initialized|Unloading .*module|Using input driver|Loading .*module|Matrox|AIGLX:|Markers: \(--\) probed|Running in \w+-mode|Entry deleted from|The XKEYBOARD keymap compiler|font path|pci id for fd|ABI class:|Errors from .* not fatal|glx: failed|Failed to grab accelerator|If no devices become available|Unsupported high keycode|Could not resolve keysym|font directory|Default Screen Section|to colour .* device|Extension :|X\.Org ANSI C|cannot support keycodes|Failed to abandon session scope|X\.Org X Server|Failed to load module .* \(module does not exist", False),
    ("INFO_NOISE", r"Skipped \d+|message repeated|Hardware name:|BIOS|kernel module|Initializing the GPFS|automatic interface scanning|closing TCT|Setting log level|CAUTION|Dynamic interrupt throttling|Deprecated parameter|Using mlock ulimits|audit daemon|switch has rebooted|HTTP error 500 on POST|Allocated shared GPFS|Content changed during rsync|Last unloaded:|mlx5_core.*Missing SyncE|igb.*Reset adapter|snd_hda_intel|pnp 00:|bpmcd|can't read from|cannot create socket|indirect call not allowed|device .* set up|run_command_poll_child|chan_read_failed|Already killed|Received disconnect|_open_as_other|MaxStartups|cannot listen to port|connect_to localhost|no more sessions|hrtimer|initial_batch_size|kernel read not supported|unexpected unlock status|max_batch_size|max_fabric_packet_age|max_no_matching|max_resource_busy|max_spt_retries|max_trs_pend_rsp|message too long|min_free_kbytes|error forwarding|remote server|failed to set xattr|pause_wait_time|pct_cfg_timing|peer_tct_free_wait_time|rsync returned|RT throttling|spt_timeout_epoch_sel|statsFS|mems_allowed|tct_timeout_epoch_sel|client does not accept|warn_alloc|warn_unsupported|warning during parsing|nvidia-caps-imex|PEFILE|PKRU|REQTMOUT|Received unknown opcode|Return Package|See systemctl|See \"\"systemctl|total number of facts|Unloaded tainted|VFS: Lookup|Watching pool|Workqueue:|Wrapped exception|Abandoning IO|Killing connection|Unable to contact|Duplicated hardware|Unable to set up|No AMA found|commMsgCheckMessages|Local host not found|Adding nid|Removing nid|Attempted connection|Can't get traces|Can't load configuration|Can't write to|Cannot find unit|Could not open command|Could not send report|conserver.service|pe.service|compatibility logic is deprecated|Device: /dev/sd|Flags: TI-RPC|NO devices found|retry backoff|Lustre: Mounted|See \"systemctl status|Successfully deleted service|DVS: Revision|Disabling lock debugging|Connection lasted|Interface wait time|restricted to a subset of cpus|TOPOLOGY: no switch|smartd\.service|Predictable network names|LNet.*deprecated|</TASK>|#\d+|build_script|Maximum GFX clk|\{\"@timestamp\":|filebeat|beat|TRACE|ROCm System Management Interface|xGMI error counters not enabled|Potentially caused by missing/incomplete job|No registered file transfer|telegraf\.service|stuck for \d+s|cray_power_management|dvsipc|craytrace|ksocklnd|lnet\(OEn\)|dvsproc|llc\(E\)|fmpm|Overwriting existing symlink|legacy kernel without|slabs: \d+|Traceback|nsprepkg|callbacks suppressed|scheduler tick|Activating service|Successfully activated|module .* already in this config|system status/update|exiting\.|Worker \[\d+\] failed|metric.* \(\d+\.\d+s\)|cpuset=|active=|refcnt=|flags=|node=|cpus=|libEGL warning|failed to enable I/O ports|Applying InputClass|is tagged by udev as|CPU features:|wait_time|C_ATU_STS_|syslog.socket|Current version of|Unknown error|mem-tx:|IA GA PC|CXI retry handler version|Not setting|Unable to get user's local|jackdbus|xfs filesystem .* supports timestamps|report bugs on|latest version|received this message due to a bug|timeout_backoff_multiplier|empty or malformed|X2APIC|NX|^\d+, \d+$|PC GA|GT IA|Failed to connect to avahi|Runtime directory .* not owned|checkname failed|PV .* online|VG .* complete|Module .* not loaded|\[\d+\]|Deferred|Supervising process|root directory access|step_|automatic interface scanning|reporting|tx:|compiled for|VG unknown|PPR|GT|Before reporting problems|process and the information|Using a default|Enabled .* GPEs|backoff_multiplier|This warning only shows|empty or null message|unit configures an IP firewall|is deprecated|WARNING: Use sudo|unknown input|bugs on either our web page|informational message about|system status/update|GA PC|Lustre: .* failed, not fatal|rcu: All QSes seen|cache: [\w_-]+, object size:|VG .* finished|amdgpu_irq_handle|failed to reload|supported: no, unsupported modules|ida_free called for|WARNING: \$ sudo|TaskKilled \(another attempt succeeded\)|TaskSetManager: Lost task", False),
]
