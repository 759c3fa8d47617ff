"""Fixed values of the case documents and of the answer texts.

These are part of the data contract (key names, template names, markers, limits); results are only
right if they match the producers of the documents, so they are stated here and nowhere else.
"""

from __future__ import annotations

# --- fixed values: log sections and templates -------------------------------------------------
EXCEPTION_SECTIONS = ("local_exception", "remote_exception")
EXCEPTION_TEMPLATES = (
    "Reason=Interface physical link is down",
    "Reason=BGP direct connect-interface down",
    "The local fault alarm has occurred",
    "The physical status of the port changed to down",
    "The remote fault alarm has occurred",
    "Optical Module is invalid",
    "The BFD session went Down",
    "hwBfdSessDown(t)",
    "CurrState=ESTABLISHED",
    "CMDRECORD",
    "REBOOT",
)
FLASH_SECTIONS = ("local_flash", "remote_flash")
FLASH_PAIRS = (
    ("linkDown_active(l)", "linkDown_clear(l)"),
    ("hwPortDown(l)", "hwPortUp(l)"),
    ("hwBgpBackwardTransition_active(l)", "hwBgpBackwardTransition_clear(l)"),
    ("bgpBackwardTransition_active(l)", "bgpBackwardTransition_clear(l)"),
)
FLASH_SINGLE = "PEER_STATE_CHG(l)"
FLASH_TEMPLATES = tuple(name for pair in FLASH_PAIRS for name in pair) + (FLASH_SINGLE,)
SHUTDOWN_SECTIONS = ("local_shutdown", "remote_shutdown")
TEMPLATE_COUNTS = "template_occur_count"
FLASH_COUNT = "flash_count"

# --- fixed values: KPI names and selection tokens ---------------------------------------------
KPIS = (
    "traffic_in",
    "traffic_out",
    "drop_packet_rate",
    "error_packet_rate",
    "offline_loss_rate",
    "cpu_utilization",
    "memory_utilization",
    "temperature",
)
SEGMENT_TOKENS = ("mix", "alarming")
STAT_TOKENS = ("max", "min", "mean", "duration")

# --- fixed values: status texts ---------------------------------------------------------------
BGP_UP = "Established"
INTERFACE_CODES = {"UP": 0, "ERROR DOWN": 2, "Administratively DOWN": 3}
INTERFACE_MISSING = 1
INTERFACE_OTHER = 4
OWNER_MARK = "DCN"
RESOURCE_RUNNING = "Running"
VLAN_MARK = "Vlan"
LIFE_IN_USE = "使用中"
REBOOT_WINDOW_MS = 3600 * 1000
MILLISECONDS_ABOVE = 1e12

# --- fixed values: file names (regular expressions after the optional "<scenario>_" prefix) ----
LOOSE_INDEX = r"_(\d+)_label_"
INDEX_NUMBER = r"(0|[1-9]\d*)"
LABEL_NAMES = (  # (needs scenario prefix, pattern), in order of priority
    (True, rf"^{INDEX_NUMBER}_label_.*\.json$"),
    (False, rf"^{INDEX_NUMBER}_label_.*\.json$"),
    (False, rf"^label_{INDEX_NUMBER}\.json$"),
    (False, rf"^{INDEX_NUMBER}\.json$"),
)
CASE_NAMES = (
    (True, rf"^{INDEX_NUMBER}_case_.*\.json$"),
    (False, rf"^{INDEX_NUMBER}_case_.*\.json$"),
    (False, rf"^case_{INDEX_NUMBER}\.json$"),
    (False, rf"^case-{INDEX_NUMBER}\.json$"),
    (False, rf"^{INDEX_NUMBER}\.json$"),
)
SERIAL_IN_NAME = r"(?is)_(\d+)_label_(.+)\.json$"

# --- fixed values: answers --------------------------------------------------------------------
THINK_END = "</think>"
FALLBACK_TAIL = 6000
STRUCTURED = "structured_array"
TEXT_FALLBACK = "candidate_text_fallback"
UNPARSED = "unparsed"
MISSING_RUN = "missing_scenario_output_dir"
RERUN_FAILED = "rerun_inference_failed"
FAILURES = (UNPARSED, MISSING_RUN, RERUN_FAILED)
STOP_MARKER = '["(上一轮次已经符合要求)"]'
NO_PREVIOUS_ROUND = "无上一轮输出。"
ANSWER_CUT_MARK = "\n\n[...日志过长，中间部分已截断...]\n\n"
PROMPT_CUT_MARK = "\n\n[中间过长内容已截断]\n\n"
LOG_CUT_NOTE = "anomaly_logs 超出 Prompt token 预算，仅保留首尾内容"
NO_LOGS_SCENARIO = "入方向带宽利用率过高"
EXAMPLE_LEAD = "示例："
RULE = "=" * 50

# --- fixed values: samplers of the competition stage ------------------------------------------
SAMPLERS = (
    ("Reasoner1", 0.1, 0.9),
    ("Reasoner2", 0.5, 0.95),
    ("Reasoner3", 0.8, 1.0),
)

# --- fixed values: defaults -------------------------------------------------------------------
INITIAL_LAST_INDEX = -1
TRAIN_N = 50
MAX_DEPTH = 3
MIN_SAMPLES_LEAF = 10
DEPTH_CANDIDATES = (2, 3, 4, 5)
ANSWER_MAX_CHARS = 9000
MAX_ROUNDS = 5
BATCH_SIZE = 16
WRONG_CASES = 8
CORRECT_CASES = 2
FEATURES_PER_CASE = 20
MODEL_LENGTH = 16384
OUTPUT_TOKENS = 4096
SAFETY_TOKENS = 512
