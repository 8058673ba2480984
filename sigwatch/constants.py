"""Fixed values that results depend on.

Lists, limits, names and messages below have to equal the published ones for the
results to be the same, so they are stated as they are.
"""

# Address ranges of known bad networks.
BAD_RANGES = [
    "23.155.208.0/24", "23.159.56.0/24", "23.161.8.0/24", "23.170.224.0/24",
    "23.171.200.0/24", "23.175.136.0/24", "23.185.184.0/24", "41.57.124.0/22",
    "41.72.0.0/23", "41.77.64.0/21", "41.204.224.0/24", "45.148.10.0/24",
    "198.211.109.0/24", "143.198.202.0/24", "198.8.96.0/19", "103.174.186.0/24",
]

# Networks of the operator itself.
HOME_NETWORKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]

# Text prefixes that the spoofing rule takes as internal.
HOME_PREFIXES = ["10.", "192.168", "172.16"]

# IPv4 blocks that are not globally routable (IANA special-purpose registry).
PRIVATE_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
PUBLIC_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]

# Single bad addresses.
BAD_ADDRESSES = [
    "49.206.11.246", "147.28.184.4", "198.211.109.73", "128.199.251.153", "82.165.88.169",
    "113.182.44.91", "143.198.202.211", "159.65.60.60", "180.41.108.52", "219.79.211.11",
    "80.94.95.112", "47.128.51.115", "45.148.10.84", "195.184.76.39", "125.23.255.134",
    "117.254.101.69", "92.118.39.61", "121.121.157.145", "10.97.120.28", "10.97.32.173",
    "172.16.98.1", "172.16.98.102", "172.16.98.145", "172.16.98.101", "10.33.6.101",
    "10.33.6.100", "127.0.0.1", "10.97.80.61", "10.97.72.112", "10.97.32.172",
    "10.97.44.28", "10.97.176.201", "10.97.64.44", "10.97.176.91", "10.97.56.15",
    "10.97.40.180", "10.97.136.63", "10.97.88.59", "10.97.80.181", "10.97.176.52",
    "10.97.128.134", "10.97.40.202", "23.155.208.154", "23.159.56.201", "23.161.8.77",
    "41.57.124.92", "45.148.10.111", "103.174.186.55",
]

UNAUTHORISED_NODES = ["9999999999"]

FOREIGN_WORDS = ["roaming", "foreign", "external"]

# Operation signatures in the payload, as hex; ".." stands for any byte but 0a.
PAYLOAD_SIGNATURES = {
    "send_routing_info": "a1..02010102011630",
    "send_routing_info_for_sm": "a1..0201..02012d",
    "provide_subscriber_info": "a2..02010130..02014630",
    "update_location": "a1..02010102010230",
    "cancel_location": "a1..020101020103a3",
    "insert_subscriber_data": "a1..0201..02010730",
}

# Rule name, weight and threat name, in the order the main threat is decided.
RULES = [
    ("flooding", 3, "Flooding IMSI"),
    ("unauth_node", 3, "Nodo no autorizado"),
    ("sri", 3, "Ataque SRI"),
    ("psi", 3, "Seguimiento de ubicación"),
    ("hlr_update", 3, "Modificación no autorizada de HLR"),
    ("spoofing", 2, "Suplantación de nodo"),
    ("roaming_bypass", 2, "Bypass de roaming"),
    ("integrity", 2, "Integridad de datos sospechosa"),
    ("payload", 2, "Patrón malicioso detectado"),
    ("blocklist", 1, "IP en lista negra"),
]
OTHER_THREAT = "Anomalía SS7"
ANOMALY_SCORE = 3

# Operations counted between two location updates.
OPERATIONS = [
    "cl", "psi", "dsd", "fwsm_mo", "fwsm_mt", "fwsm_report", "fwsm_submit", "isd", "prn",
    "purge_ms", "sai", "si", "sri", "srism", "ul", "ulgprs", "ussd",
]
LOCATION_UPDATES = ["ul", "ulgprs"]

# Risk bands: over 90 block, over 50 notify, else monitor.
BLOCK_OVER = 90.0
NOTIFY_OVER = 50.0
ACTION_BLOCK, ACTION_NOTIFY, ACTION_MONITOR = "bloquear", "notificar", "monitorear"

TOPIC_ALERTS, TOPIC_SIP_ALERTS, TOPIC_NOTICES = "alerts", "alerts_Suricata", "notices"
NOTICE_KIND = "ALERTA_MODERADA"
NOTICE_TEXT = "Se detectó una alerta moderada desde la IP %s. El operador debe tomar medidas."
DEFAULT_SIP_ALERT = "SIP Alert"

# SIP rules: id, class, message.
SIP_RULES = [
    (1000001, "attempted-dos", "SIP INVITE - posible ataque de llamada masiva"),
    (1000002, "attempted-recon", "SIP REGISTER - posible ataque de enumeración"),
    (1000003, "protocol-command-decode", "SIP comando desconocido - posible fuzzing"),
    (1000004, "web-application-attack", "SIP User-Agent sospechoso - posible escáner o exploit"),
]
# Severity of each class (public default classification of the IDS rule language).
SIP_CLASS_SEVERITY = {
    "attempted-dos": 2,
    "attempted-recon": 2,
    "protocol-command-decode": 3,
    "web-application-attack": 1,
}

THRESHOLDS = [0.3, 0.4, 0.5, 0.6]
DEFAULT_THRESHOLD = 0.5

# Columns of the labelled feature table, in file order.
FEATURE_TABLE = [
    "src_ip",
    "hex_payload",
    "_time",
    "c_timestamp",
    "c_cggt",
    "c_imsi",
    "f_c_ossn_others",
    "f_same_cggt_is_gmlc_oc",
    "f_same_cggt_is_gmlc_ossn",
    "f_same_cggt_is_hlr_oc",
    "f_same_cggt_is_hlr_ossn",
    "f_count_ok_cl_between2lu",
    "f_count_ok_psi_between2lu",
    "f_velocity_greater_than_1000",
    "f_count_unloop_country_last_x_hours_ul",
    "f_count_gap_ok_sai_and_all_lu",
    "f_count_ok_dsd_between2lu",
    "f_count_ok_fwsm_mo_between2lu",
    "f_count_ok_fwsm_mt_between2lu",
    "f_count_ok_fwsm_report_between2lu",
    "f_count_ok_fwsm_submit_between2lu",
    "f_count_ok_isd_between2lu",
    "f_count_ok_prn_between2lu",
    "f_count_ok_purge_ms_between2lu",
    "f_count_ok_sai_between2lu",
    "f_count_ok_si_between2lu",
    "f_count_ok_sri_between2lu",
    "f_count_ok_srism_between2lu",
    "f_count_ok_ul_between2lu",
    "f_count_ok_ulgprs_between2lu",
    "f_count_ok_ussd_between2lu",
    "f_frequent_ok_cl_between2lu",
    "f_frequent_ok_psi_between2lu",
    "f_frequent_ok_dsd_between2lu",
    "f_frequent_ok_fwsm_mo_between2lu",
    "f_frequent_ok_fwsm_mt_between2lu",
    "f_frequent_ok_fwsm_report_between2lu",
    "f_frequent_ok_fwsm_submit_between2lu",
    "f_frequent_ok_isd_between2lu",
    "f_frequent_ok_prn_between2lu",
    "f_frequent_ok_purge_ms_between2lu",
    "f_frequent_ok_sai_between2lu",
    "f_frequent_ok_si_between2lu",
    "f_frequent_ok_sri_between2lu",
    "f_frequent_ok_srism_between2lu",
    "f_frequent_ok_ul_between2lu",
    "f_frequent_ok_ulgprs_between2lu",
    "f_frequent_ok_ussd_between2lu",
    "f_ratio_cl_psi",
    "f_high_activity_5min",
    "f_one_cggt_multi_cdgt_psi",
    "f_msg_count_per_imsi",
    "c_network_node_number",
]
