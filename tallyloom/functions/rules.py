"""Fixed values of requirement reading: fields, weights, keywords, patterns and categories.

They decide results and are kept as plain text, in their natural order; the order of
CATEGORY_KEYWORDS and of HA_MODES matters, as the first that fits wins.
"""

from __future__ import annotations

#: Categories of equipment around the network; they are looked for before all others.
ARCHITECTURE = ["UPS", "COOLING", "POWER_DISTRIBUTION", "RACK_PDU", "CONTAINMENT", "RACK", "MONITORING", "FIRE_SUPPRESSION", "FIRE_DETECTION", "FIRE_ALARM", "CAMERA", "DISPLAY"]

CATEGORY_KEYWORDS = {
    "CENTRALIZED_MANAGEMENT": ["fortimanager", "centralized management", "firewall manager", "security management"],
    "LOGGING": ["fortilogger", "hardware logging", "log reporting", "logging appliance", "firewall logging", "log backup"],
    "SIEM_SOC": ["fortisiem", " siem ", "soc platform", "security information and event management"],
    "NDR": ["fortindr", "ndr", "network detection and response"],
    "ENDPOINT_SECURITY": ["fortiedr", "fortixdr", "forticlient", "endpoint security", "edr", "xdr"],
    "IDENTITY_ACCESS": ["fortiauthenticator", "identity access", "identity and access", "radius server", "authentication appliance"],
    "PAM": ["fortipam", "privileged access", "pam"],
    "SANDBOX": ["fortisandbox", "sandbox", "malware analysis", "file analysis"],
    "EMAIL_SECURITY": ["fortimail", "email security", "mail security", "secure email gateway"],
    "NAC": ["fortinac", "network access control", " nac ", "control and application server"],
    "DECEPTION": ["fortideceptor", "deception"],
    "SOAR": ["fortisoar", "soar", "orchestration automation response"],
    "SASE": ["fortisase", "sase"],
    "SECURE_WEB_GATEWAY": ["fortiproxy", "secure web gateway", "web proxy", "swg"],
    "DDOS_MITIGATION": ["fortiddos", "ddos"],
    "DIGITAL_RISK_PROTECTION": ["fortirecon", "digital risk protection", "external attack surface"],
    "NETWORK_PERFORMANCE_MONITORING": ["fortimonitor", "network performance monitoring", "monitoring"],
    "AI_NETWORK_OPERATIONS": ["fortiaiops", "aiops", "ai network operations"],
    "CLOUD_SECURITY": ["forticnapp", "cnapp", "cloud security"],
    "WAN_EXTENDER": ["fortiextender", "wan extender", "lte wan", "5g wan"],
    "VOIP_SECURITY": ["fortivoice", "voip", "voice security"],
    "VIDEO_SECURITY": ["fortirecorder", "video security", "nvr"],
    "SDN_AUTOMATION": ["apstra", "sdn", "automation", "intent-based networking"],
    "WAF": ["web application firewall", " waf ", "fortiweb"],
    "ADC": ["load balancer", "application delivery", " adc ", "fortiadc"],
    "DATACENTER_SWITCH": ["data center switch", "datacenter switch", " tor ", "top of rack", "leaf", "spine", "core network", "qfx", "fortiswitch 1048", "fortiswitch 3032"],
    "ACCESS_SWITCH": ["access switch", "campus switch", "edge switch", "fortiswitch 448", "ex4400"],
    "SWITCH": ["switch", "switching"],
    "ROUTER": ["router", "routing platform", "edge routing", "wan router"],
    "NGFW": ["ngfw", "next generation firewall", "firewall", "security gateway", "ssl-vpn", "ssl vpn", "vpn appliance"],
    "UPS": ["ups", "uninterruptible power", "battery backup", "kva ups", "kw ups", "liebert apm", "liebert mtp"],
    "COOLING": ["precision cooling", "row cooling", "cooling unit", "thermal management", "crv4", "computer room air"],
    "POWER_DISTRIBUTION": ["power distribution", "server power distribution", "spm", "distribution panel"],
    "RACK_PDU": ["rack pdu", "rpdu", "geist", "power distribution unit"],
    "CONTAINMENT": ["containment", "cold aisle", "hot aisle", "smartaisle"],
    "RACK": ["rack enclosure", "server rack", "ve rack", "42u rack", "48u rack"],
    "MONITORING": ["infrastructure monitoring", "environmental monitoring", "rdu501", "monitoring gateway"],
    "FIRE_SUPPRESSION": ["fire suppression", "extinguishing", "fk-5-1-12", "nozzle", "check valve", "releasing control"],
    "FIRE_DETECTION": ["smoke detector", "fire detection", "airsense", "truealarm", "aspirating smoke"],
    "FIRE_ALARM": ["fire alarm", "manual station", "nac extender", "horn", "bacpac"],
    "CAMERA": ["camera", "cctv", "ip camera", "image sensor"],
    "DISPLAY": ["display", "video wall", "lcd panel", "narrow bezel"],
}

#: A requirement that holds one of these is out of scope.
EXCLUDED = ["generator", "hvac", "patch cord", "cabling", "civil work", "electrical", "storage array", "san switch", "gpu", "license only", "subscription only"]

#: Labels of counted fields.
COUNT_LABELS = {
    "concurrent_sessions": ["concurrent sessions", "sessions"],
    "ssl_vpn_users": [
        "ssl vpn users", "ssl-vpn users", "ssl vpn concurrent users", "ssl-vpn concurrent users", "ssl vpn concurrent user", "ssl-vpn concurrent user",
        "ssl vpn user license", "ssl-vpn user license", "ssl vpn concurrent user license", "ssl-vpn concurrent user license", "vpn users", "concurrent users",
    ],
    "connections_per_second": ["connections per second", "connections per seconds", "cps", "new sessions per second"],
    "policies": ["policies", "firewall policies"],
    "logs_per_day_gb": ["gb logs per day", "gb/day", "logs per day"],
    "analytic_rate_logs_sec": ["analytics logs/sec", "analytic logs/sec", "analytics rate"],
    "collector_rate_logs_sec": ["collector logs/sec", "collection logs/sec", "collector rate"],
    "performance_eps": ["eps", "events per second"],
    "email_routing_per_hour": ["email routing per hour", "messages per hour", "emails per hour"],
    "atp_per_hour": ["atp per hour", "atp scans per hour"],
    "email_domains": ["email domains", "domains"],
    "server_mode_mailboxes": ["mailboxes", "server mode mailboxes"],
    "max_ports": ["managed ports", "ports"],
    "max_devices_vdoms": ["devices", "vdoms", "managed devices"],
    "max_local_remote_users": ["local users", "remote users", "users"],
    "max_user_groups": ["user groups", "groups"],
    "max_nas_devices": ["nas devices", "radius clients"],
    "max_fortitokens": ["fortitokens", "tokens"],
}

#: Counted fields and capacities (field, unit) that only one category has.
CATEGORY_COUNTS = {
    "RACK": {"rack_units": ["u rack", "rack units", "u enclosure"], "static_load_kg": ["kg static load", "kg load", "static load"]},
    "MONITORING": {"sensor_capacity": ["sensors", "sensor"]},
    "RACK_PDU": {"outlet_count": ["outlets", "sockets", "socket"]},
}
CATEGORY_CAPACITY = {
    "UPS": {"power_capacity_kva": "kva", "power_capacity_kw": "kw"},
    "COOLING": {"cooling_capacity_kw": "kw"},
    "POWER_DISTRIBUTION": {"power_capacity_kva": "kva"},
}

THROUGHPUT_FIELDS = ["ssl_vpn_gbps", "ipsec_vpn_throughput_gbps", "ssl_tls_inspection_gbps", "ips_throughput_gbps", "threat_protection_gbps", "switching_capacity_gbps", "ngfw_throughput_gbps", "throughput_gbps"]
#: A clause with one of these is classified by itself, without its surroundings.
THROUGHPUT_SIGNALS = ["ssl vpn", "ssl-vpn", "ipsec", "ssl", "tls", "inspection", "decrypt", "ips", "intrusion prevention", "threat", "switching", "backplane", "fabric", "next generation firewall", "ngfw", "firewall throughput"]

#: Interface counts ``n x speed``, ``ports of speed: n`` and ``speed ports n``, by interface.
INTERFACES = {
    "400g_qsfp_dd": [r"(\d+)\s*(?:x|×)?\s*(?:400\s*g|400gbe|400\s*gbps).*?(?:qsfp-dd|qsfpdd)?", r"(?:interfaces?|ports?).{0,50}400\s*(?:g|gig|gbe|gbps).{0,35}(?:qsfp-dd|qsfpdd)?.{0,15}(?:=|:|qty|quantity|count)\s*(\d+)", None],
    "200g_qsfp56": [r"(\d+)\s*(?:x|×)?\s*(?:200\s*g|200gbe|200\s*gbps).*?(?:qsfp56|qsfp)?", r"(?:interfaces?|ports?).{0,50}200\s*(?:g|gig|gbe|gbps).{0,35}(?:qsfp56|qsfp)?.{0,15}(?:=|:|qty|quantity|count)\s*(\d+)", None],
    "50g_sfp56": [r"(\d+)\s*(?:x|×)?\s*(?:50\s*g|50gbe|50\s*gbps).*?(?:sfp56)?", r"(?:interfaces?|ports?).{0,50}50\s*(?:g|gig|gbe|gbps).{0,35}(?:sfp56)?.{0,15}(?:=|:|qty|quantity|count)\s*(\d+)", None],
    "100g_qsfp28": [r"(\d+)\s*(?:x|×)?\s*(?:100\s*g|100gbe|100\s*gbps|hundred\s*gigabit).*?(?:qsfp28|qsfp)?", r"(?:interfaces?|ports?).{0,50}(?:100\s*(?:g|gig|gbe|gbps)|hundred\s*gigabit).{0,35}(?:qsfp28|qsfp)?.{0,15}(?:=|:|qty|quantity|count)\s*(\d+)", None],
    "40g_qsfp_plus": [r"(\d+)\s*(?:x|×)?\s*(?:40\s*g|40gbe|40\s*gbps).*?(?:qsfp\+|qsfp)?", r"(?:interfaces?|ports?).{0,50}40\s*(?:g|gig|gbe|gbps).{0,35}(?:qsfp\+|qsfp)?.{0,15}(?:=|:|qty|quantity|count)\s*(\d+)", None],
    "25g_sfp28": [r"(\d+)\s*(?:x|×)?\s*(?:25\s*g|25gbe|25\s*gbps).*?(?:sfp28)?", r"(?:interfaces?|ports?).{0,50}25\s*(?:g|gig|gbe|gbps).{0,35}(?:sfp28)?.{0,15}(?:=|:|qty|quantity|count)\s*(\d+)", r"25\s*(?:g|ge|gig|gbe|gbps).{0,40}(?:sfp28|sfp).{0,80}?(?:interfaces?|ports?).{0,80}?(\d+)"],
    "10g_sfp_plus": [r"(\d+)\s*(?:x|×)?\s*(?:10\s*g|10gbe|10\s*gbps).*?(?:sfp\+|sfp plus|sfp)?", r"(?:interfaces?|ports?).{0,50}10\s*(?:g|gig|gbe|gbps).{0,35}(?:sfp\+|sfp plus|sfp)?.{0,15}(?:=|:|qty|quantity|count)\s*(\d+)", r"10\s*(?:g|ge|gig|gbe|gbps).{0,40}(?:sfp\+|sfp plus|sfp).{0,80}?(?:interfaces?|ports?).{0,80}?(\d+)"],
    "1_10g_rj45": [r"(\d+)\s*(?:x|×)\s*(?:1/10\s*(?:g|ge|gbe|gbps)|1g/10g|10\s*(?:g|ge|gbe|gbps)).{0,35}?(?:rj45|base-t|copper)", r"(?:interfaces?|ports?).{0,50}(?:1/10\s*(?:g|ge|gbe|gbps)|1g/10g|10\s*(?:g|ge|gbe|gbps)).{0,35}(?:rj45|base-t|copper).{0,15}(?:=|:|qty|quantity|count)\s*(\d+)", r"(?:1\s*/\s*10|10)\s*(?:g|ge|gig|gbe|gbps).{0,45}(?:rj45|base-t|copper).{0,40}?(\d+)"],
    "1g_rj45": [r"(\d+)\s*(?:x|×)?\s*(?:1\s*g|1gbe|gigabit).*?(?:rj45|base-t|copper)", r"(?:interfaces?|ports?).{0,50}(?:copper|rj45|base-t).{0,25}(?:1\s*(?:g|gig|gbe|gbps)|gigabit).{0,15}(?:=|:|qty|quantity|count)\s*(\d+)", r"(?:1\s*(?:g|ge|gig|gbe|gbps)|gigabit).{0,50}(?:rj45|base-t|copper).{0,80}?(?:interfaces?|ports?)?.{0,80}?(\d+)"],
}

#: What a text holds wherever one of the interface's patterns fits.
INTERFACE_SIGNS = {
    "400g_qsfp_dd": ["400"], "200g_qsfp56": ["200"], "50g_sfp56": ["50"], "100g_qsfp28": ["100", "hundred"], "40g_qsfp_plus": ["40"], "25g_sfp28": ["25"], "10g_sfp_plus": ["10"],
    "1_10g_rj45": ["rj45", "base-t", "copper"], "1g_rj45": ["rj45", "base-t", "copper"],
}

HA_MODES = [
    ("active-passive", r"active\s*[-/ ]\s*passive|\ba-p\b"),
    ("active-active", r"active\s*[-/ ]\s*active|\ba-a\b"),
    ("fgcp", r"\bfgcp\b"),
    ("fgsp", r"\bfgsp\b"),
    ("virtual clustering", r"virtual\s+cluster(?:ing)?"),
    ("clustering", r"cluster(?:ing)?"),
]
#: What a text holds wherever a pattern of a mode fits.
HA_SIGNS = ["active", "fgcp", "fgsp", "cluster", "a-p", "a-a"]
#: Flags and the patterns that set them.
FLAGS = {
    "ha_supported": r"\bha\s+(?:configuration|mode|pair|cluster)\b|high availability|active[\s/-]*passive|active[\s/-]*active|\bfgcp\b|\bfgsp\b|virtual\s+cluster|cluster(?:ing)?|\ba-p\b|\ba-a\b",
    "ha_port": r"\bha\s+(?:ports?|interfaces?)\b|\b(?:ports?|interfaces?)\s+(?:for\s+)?ha\b|dedicated\s+ha\b",
    "redundant_power": r"redundant\s+power(?:\s+supply)?|dual\s+(?:ac\s+)?power|dual\s+psu|1\+1\s+redundancy",
    "management_port": r" management port|mgmt port",
    "console_port": r" console port",
}
#: What a text with single blanks holds wherever the flag's pattern fits.
FLAG_SIGNS = {
    "ha_supported": ["ha configuration", "ha mode", "ha pair", "ha cluster", "high availability", *HA_SIGNS],
    "ha_port": ["ha port", "ha interface", "port ha", "ports ha", "interface ha", "interfaces ha", "for ha", "dedicated ha"],
    "redundant_power": ["redundan", "dual"],
    "management_port": ["port"],
    "console_port": ["port"],
}

# Constraints and products: fixed values.

#: Numeric fields of requirements and products.
NUMERIC_FIELDS = [
    "ports", "max_ports", "ipsec_vpn_throughput_gbps", "ngfw_throughput_gbps", "ips_throughput_gbps", "ssl_tls_inspection_gbps", "ssl_vpn_gbps", "threat_protection_gbps",
    "switching_capacity_gbps", "firewall_throughput_gbps", "throughput_gbps", "concurrent_sessions", "ssl_vpn_users", "connections_per_second", "logs_per_day_gb", "analytic_rate_logs_sec",
    "collector_rate_logs_sec", "performance_eps", "email_routing_per_hour", "atp_per_hour", "email_domains", "server_mode_mailboxes", "max_devices_vdoms", "max_local_remote_users",
    "max_user_groups", "max_nas_devices", "max_fortitokens", "policies", "storage_tb", "power_capacity_kw", "power_capacity_kva", "cooling_capacity_kw", "rack_units", "static_load_kg",
    "sensor_capacity", "outlet_count",
]
BOOLEAN_FIELDS = ["ha_supported", "ha_port", "management_port", "console_port", "redundant_power"]
RANGE_FIELDS = ["power_capacity_kw", "power_capacity_kva", "cooling_capacity_kw"]

#: Fields of a product that stand in for one that it lacks.
SPEC_ALIASES = {
    "ipsec_vpn_throughput_gbps": ["vpn_throughput_gbps"],
    "firewall_throughput_gbps": ["ngfw_throughput_gbps", "throughput_gbps"],
    "ngfw_throughput_gbps": ["firewall_throughput_gbps", "throughput_gbps"],
    "switching_capacity_gbps": ["throughput_gbps"],
    "throughput_gbps": ["switching_capacity_gbps", "ngfw_throughput_gbps"],
    "connections_per_second": ["cps"],
    "performance_eps": ["analytic_rate_logs_sec", "collector_rate_logs_sec"],
    "max_ports": ["ports"],
}

#: Metadata fields that count interfaces, and which.
INTERFACE_FIELDS = {
    "interfaces_1g": "1g_rj45",
    "interfaces_10g": "10g_sfp_plus",
    "interfaces_25g": "25g_sfp28",
    "interfaces_40g": "40g_qsfp_plus",
    "interfaces_50g": "50g_sfp56",
    "interfaces_100g": "100g_qsfp28",
    "interfaces_200g": "200g_qsfp56",
    "interfaces_400g": "400g_qsfp_dd",
}

#: Interfaces that serve a required one.
INTERFACE_COMPATIBILITY = {
    "1g_rj45": ["1g_rj45", "1_10g_rj45"],
    "10g_rj45": ["10g_rj45", "1_10g_rj45"],
    "1_10g_rj45": ["1_10g_rj45", "10g_rj45"],
    "1g_sfp": ["1g_sfp"],
    "10g_sfp_plus": ["10g_sfp_plus", "25g_sfp28"],
    "25g_sfp28": ["25g_sfp28", "50g_sfp56"],
    "40g_qsfp_plus": ["40g_qsfp_plus", "100g_qsfp28"],
    "100g_qsfp28": ["100g_qsfp28", "200g_qsfp56", "400g_qsfp_dd"],
    "200g_qsfp56": ["200g_qsfp56", "400g_qsfp_dd"],
    "400g_qsfp_dd": ["400g_qsfp_dd"],
}

#: Speed in Gbps by which a count may have been multiplied.
INTERFACE_SPEED = {
    "1g_rj45": 1, "10g_rj45": 10, "1_10g_rj45": 10, "1g_sfp": 1, "10g_sfp_plus": 10, "25g_sfp28": 25, "40g_qsfp_plus": 40, "50g_sfp56": 50, "100g_qsfp28": 100, "200g_qsfp56": 200,
    "400g_qsfp_dd": 400,
}

#: Weights of the fit by field; 1 for others.
FIT_WEIGHTS = {
    "firewall_throughput_gbps": 1.45, "ngfw_throughput_gbps": 1.55, "ips_throughput_gbps": 1.35, "threat_protection_gbps": 1.35, "ipsec_vpn_throughput_gbps": 1.25,
    "ssl_tls_inspection_gbps": 1.25, "ssl_vpn_gbps": 1.15, "switching_capacity_gbps": 1.45, "throughput_gbps": 1.35, "concurrent_sessions": 1.15, "connections_per_second": 1.10,
    "ports": 1.20, "max_ports": 1.20, "interfaces": 1.35, "storage_tb": 0.90,
}
GENERIC_HA_MODES = ["active-passive", "active-active", "clustering"]
#: Fields whose logarithms say how large a product is if its name holds no number.
SCALE_FIELDS = ["firewall_throughput_gbps", "ipsec_vpn_throughput_gbps", "ngfw_throughput_gbps", "ips_throughput_gbps", "concurrent_sessions", "ssl_vpn_users"]

#: Names of categories, in lower case with underscores, and the category.
CATEGORY_ALIASES = {
    "ngfw": "NGFW", "next_generation_firewall": "NGFW", "firewall": "NGFW", "datacenter_switch": "DATACENTER_SWITCH", "data_center_switch": "DATACENTER_SWITCH",
    "access_switch": "ACCESS_SWITCH", "switch": "SWITCH", "switching": "SWITCH", "adc": "ADC", "waf": "WAF", "centralized_management": "CENTRALIZED_MANAGEMENT",
    "management": "CENTRALIZED_MANAGEMENT", "logging": "LOGGING", "hardware_logging": "LOGGING", "log_reporting": "LOGGING", "fortilogger": "LOGGING", "siem_soc": "SIEM_SOC",
    "siem": "SIEM_SOC", "soc": "SIEM_SOC", "ndr": "NDR", "endpoint_security": "ENDPOINT_SECURITY", "endpoint": "ENDPOINT_SECURITY", "identity_access": "IDENTITY_ACCESS",
    "identity_and_access": "IDENTITY_ACCESS", "pam": "PAM", "sandbox": "SANDBOX", "fortisandbox": "SANDBOX", "email_security": "EMAIL_SECURITY", "email": "EMAIL_SECURITY",
    "mail_security": "EMAIL_SECURITY", "nac": "NAC", "network_access_control": "NAC", "deception": "DECEPTION", "soar": "SOAR", "sase": "SASE",
    "secure_web_gateway": "SECURE_WEB_GATEWAY", "swg": "SECURE_WEB_GATEWAY", "ddos_mitigation": "DDOS_MITIGATION", "ddos": "DDOS_MITIGATION",
    "digital_risk_protection": "DIGITAL_RISK_PROTECTION", "network_performance_monitoring": "NETWORK_PERFORMANCE_MONITORING", "ai_network_operations": "AI_NETWORK_OPERATIONS",
    "cloud_security": "CLOUD_SECURITY", "wan_extender": "WAN_EXTENDER", "voip_security": "VOIP_SECURITY", "video_security": "VIDEO_SECURITY", "routing": "ROUTER", "router": "ROUTER",
    "sdn_automation": "SDN_AUTOMATION", "automation": "SDN_AUTOMATION", "ups": "UPS", "uninterruptible_power_supply": "UPS", "cooling": "COOLING", "precision_cooling": "COOLING",
    "row_cooling": "COOLING", "pdu": "RACK_PDU", "rack_pdu": "RACK_PDU", "power_distribution": "POWER_DISTRIBUTION", "containment": "CONTAINMENT", "rack": "RACK",
    "monitoring": "MONITORING", "fire_suppression": "FIRE_SUPPRESSION", "fire_detection": "FIRE_DETECTION", "fire_alarm": "FIRE_ALARM", "camera": "CAMERA", "display": "DISPLAY",
}

#: Categories of products that may serve a required one, where that is more than the category itself.
SERVING = {
    "SWITCH": ["DATACENTER_SWITCH", "ACCESS_SWITCH", "SWITCH"],
    "DATACENTER_SWITCH": ["DATACENTER_SWITCH", "SWITCH"],
    "ACCESS_SWITCH": ["ACCESS_SWITCH", "SWITCH"],
    "CENTRALIZED_MANAGEMENT": ["CENTRALIZED_MANAGEMENT", "SIEM_SOC"],
}
#: Further groups by provider, within which any category serves any other.
SERVING_GROUPS = {
    "juniper": [["ROUTER", "SDWAN_ROUTER"], ["DATACENTER_SWITCH", "ACCESS_SWITCH", "SWITCH"], ["WIRELESS_AP", "CENTRALIZED_MANAGEMENT"]],
    "vertiv": [["RACK", "ENCLOSURE", "INTEGRATED_RACK_SOLUTION"], ["COOLING", "COOLING_CONTROL"], ["POWER_DISTRIBUTION", "TRANSFER_SWITCH", "BUSWAY"], ["MONITORING", "SERIAL_CONSOLE", "KVM", "SOFTWARE"]],
}
#: Categories for which both network vendors are asked.
TWO_VENDORS = ["NGFW", "SWITCH", "DATACENTER_SWITCH", "ACCESS_SWITCH", "ROUTER"]
NETWORK_VENDORS = ["Fortinet", "Juniper"]

#: Any of these makes a requirement one for logging.
LOG_FIELDS = ["logs_per_day_gb", "analytic_rate_logs_sec", "collector_rate_logs_sec", "performance_eps"]
#: Fields of controllers and services that say nothing of a firewall.
CONTROLLER_FIELDS = [
    "logs_per_day_gb", "analytic_rate_logs_sec", "collector_rate_logs_sec", "performance_eps", "email_routing_per_hour", "atp_per_hour", "email_domains", "server_mode_mailboxes",
    "max_devices_vdoms", "max_local_remote_users", "max_user_groups", "max_nas_devices", "max_fortitokens",
]
#: Labels before a throughput.
LABELLED = {
    "ngfw_throughput_gbps": r"(?:next\s+generation\s+firewall|ngfw)\s+throughput",
    "firewall_throughput_gbps": r"(?<!generation\s)firewall\s+throughput",
    "ips_throughput_gbps": r"\bips\s+throughput",
    "threat_protection_gbps": r"threat\s+protection\s+throughput",
    "ssl_tls_inspection_gbps": r"ssl\s*/\s*tls\s+inspection\s+throughput|ssl\s+inspection\s+throughput|tls\s+inspection\s+throughput",
    "ssl_vpn_gbps": r"ssl[-\s]?vpn\s+throughput",
    "ipsec_vpn_throughput_gbps": r"ipsec\s+(?:vpn\s+)?throughput",
}
#: Users of a VPN, and users to whom a solution scales.
VPN_USERS = r"(?:ssl[-\s]?vpn|vpn)[^\d]{0,80}(\d[\d,]*)\s*(?:concurrent\s+)?users?\b"
SCALED_USERS = [
    r"\b(?:scalable|scale|handle)[^\d]{0,80}(\d[\d,]*)\s*(?:concurrent\s+)?ssl[-\s]?vpn\s+users?\b",
    r"\b(?:scalable|scale|handle)[^\d]{0,80}(\d[\d,]*)\s*concurrent[^\|.;]{0,40}ssl\s+vpn\s+users?\b",
]
SOLUTION_SCALE = r"\b(scalable|scale|license|licence|solution|pr\s+and\s+dr|pdc|sdc|redundant)\b"

#: Where a plain throughput of a firewall goes, by words of its text, in order.
PROMOTED = [
    (["ipsec", "ipsec vpn", "ipsec vpn throughput"], "ipsec_vpn_throughput_gbps"),
    (["ssl vpn", "ssl-vpn"], "ssl_vpn_gbps"),
    (["ssl", "tls", "inspection", "decrypt"], "ssl_tls_inspection_gbps"),
    (["ips", "intrusion prevention"], "ips_throughput_gbps"),
    (["threat"], "threat_protection_gbps"),
]

#: What names a product outright.
EXPLICIT_PRODUCT = [
    r"\b(?:fortigate|fortiswitch|fortimanager|fortianalyzer|fortilogger|fortisiem)\b",
    r"\bhardware\s+based\s+(?:next\s+generation\s+firewall|firewall|logging|management)\b",
    r"\b(?:firewall|ngfw)\s+(?:appliance|equipment|hardware|throughput)\b",
    r"\b(?:remote|central)\s+site\s+(?:equipment|firewall)s?\b",
    r"\b(?:ssl[-\s]?vpn)\s+(?:users?|throughput|appliance|concurrent)\b",
    r"\b(?:data\s*center|datacenter|core|access|distribution)\s+switch(?:es)?\b",
    r"\bswitching\s+capacity\b",
    r"\b(?:hardware\s+logging|logging\s+appliance|log\s+reporting|log\s+backup|firewall\s+logs?)\b",
    r"\b(?:centralized|network)\s+management\s+(?:appliance|hardware|solution)\b",
]
#: What does so in a row with its sheet, besides.
EXPLICIT_ROW = [r"\b(?:ips|threat\s+protection|ssl/tls\s+inspection)\s+throughput\b", r"\b(?:sfp\+?|sfp28|qsfp|rj45|ge\s+interfaces?)\b"]
NARRATIVE_WORDS = r"\b(procurement title|scope of work|delivery schedule|invitation to bid|bidder|eligibility|qualification|support, warranty|warranty, subscription|training|payment terms|general content|misc requirements|notes)\b"
NARRATIVE = [
    "procurement title", "scope of work", "delivery schedule", "invitation to bid", "bidder", "eligibility", "qualification", "support, warranty", "warranty, subscription", "training",
    "project timeline", "payment terms", "general content", "misc requirements", "notes",
]
HARDWARE_WORDS = ["hardware", "appliance", "device", "equipment", "logs", "management"]
SKIPPED_SHEETS = ["qualification", "pre-qualification", "prequalification", "eligibility", "evaluation criteria", "bid evaluation", "financial criteria", "commercial criteria"]
ADMIN_SHEETS = ["general content", "support", "warranty", "subscription", "misc requirement", "notes"]
#: Categories that always ask for a reference, and words that do.
REFERENCED = [
    "NGFW", "SWITCH", "DATACENTER_SWITCH", "ACCESS_SWITCH", "ROUTER", "CENTRALIZED_MANAGEMENT", "LOGGING", "SIEM_SOC", "NDR", "ENDPOINT_SECURITY", "IDENTITY_ACCESS", "PAM", "SANDBOX",
    "EMAIL_SECURITY", "NAC", "DECEPTION", "SOAR", "SASE", "SECURE_WEB_GATEWAY", "DDOS_MITIGATION", "DIGITAL_RISK_PROTECTION", "NETWORK_PERFORMANCE_MONITORING", "AI_NETWORK_OPERATIONS",
    "CLOUD_SECURITY", "WAN_EXTENDER", "VOIP_SECURITY", "VIDEO_SECURITY", "WAF", "ADC",
]
REFERENCED_WORDS = [
    "fortigate", "fortiswitch", "fortimanager", "fortianalyzer", "fortisiem", "fortilogger", "hardware logging", "log reporting", "firewall", "ngfw", "ipsec", "ssl vpn", "vpn throughput",
    "interfaces", "sfp", "qsfp", "switch", "router", "fortinet appliance",
]
JUNIPER_WORDS = [
    "juniper", "srx", "ex series", "qfx", "mx series", "acx", "ptx", "firewall", "ngfw", "switch", "router", "routing platform", "leaf", "spine", "top of rack", "access point", "wireless",
    "wi-fi", "wifi", "mist", "apstra", "session smart router", "sfp", "qsfp", "interfaces", "ipsec", "ssl vpn",
]
#: A row that states a product and its size by itself.
PRODUCT_SIGNAL = r"\b(?:hardware|appliance|equipment|device|firewalls?|switch(?:es)?|router|controller|gateway|ups|rack|pdu|cooling)\b"
SIZING_SIGNAL = r"\b(?:capacity|throughput|interfaces?|ports?|sessions?|power\s+suppl|ha\s+configuration|redundant|minimum|min|qty|quantity)\b"
#: A numbered section that states a product by itself.
SEGMENT_PRODUCT = r"\b(?:hardware|appliance|controller|gateway|firewall|switch|router|manager|logging|ups|rack|pdu|cooling)\b"
SEGMENT_DEMAND = r"\b(?:must|shall|should|provide|support|comply|required|capacity|throughput|interfaces?|licenses?)\b"

#: Rows that open a product's block, and those that never do.
NO_ANCHOR = ["gartner", "quoted firewall", "quoted firewalls", "oem of quoted", "leaders/challengers"]
LOGGING_ANCHOR = r"\b(?:hardware\s+logging|logging\s+appliance|fortilogger)\b"
ANCHORS = [
    r"\b(?:next generation firewall|ngfw|firewall appliance|remote site firewall|central site firewall)s?\b",
    r"\b(?:data center|datacenter|core|access|distribution)\s+switch(?:es)?\b",
    r"\b(?:router|routing platform|edge router)s?\b",
    r"\b(?:fortigate|fortiswitch|fortimanager|fortianalyzer|fortilogger|fortisiem)\b",
]
SIZED = r"\d+\s*(?:gbps|tbps|mbps|ge|gbe|g\b|tb|million|,)"
SPEC_WORDS = ["throughput", "sessions", "policies", "storage", "interfaces", "port", "high availability", "power supply", "routing", "inspection"]
CAPACITY_ROW = [
    r"\b(?:hardware\s+capacity|equipment\s+hardware\s+capacity|ipsec\s+vpn\s+throughput|interfaces?\s+copper|redundant\s+power|ha\s+configuration)\b",
    r"\b(?:gbps|mbps|interfaces?|redundant\s+power|active/passive|active-passive)\b",
]
FIREWALL_SHEET = r"\b(?:perimeter\s+firewalls?|next\s+generation\s+firewall|ngfw|firewall\s+appliance)\b"
FIREWALL_SIGNALS = ["ips throughput", "threat protection throughput", "ssl/tls inspection", "ssl vpn throughput", "concurrent sessions", "firewall throughput"]
FIREWALL_PORTS = r"\b(?:sfp\+?|sfp28|qsfp|rj45|ge\s+interfaces?)\b"
LOGGING_SHEET = r"\b(?:hardware\s+logging|logging\s+appliance|fortilogger|centralized\s+logging)\b"
LOGGING_WORDS = [r"\b(?:logs?|logging|reports?|analytics)\b", r"\b(?:eps|gb\s+per\s+day|firewall\s+logs?|log\s+backup)\b"]
#: Words by which a whole sheet's anchor row is chosen, by kind of sheet.
PREFERRED = {
    "firewall": ["next generation firewall throughput", "ngfw throughput", "ips throughput", "threat protection throughput", "ssl/tls inspection", "ssl vpn throughput", "concurrent sessions"],
    "logging title": ["100gb", "eps", "centralized logging", "firewall logs", "log analytics"],
    "logging rows": ["fortilogger", "hardware logging", "logging appliance", "100gb", "eps", "centralized logging", "firewall logs", "log analytics"],
    "management": ["centralized management", "unified dashboard", "configuration", "orchestration"],
    "ssl vpn": ["concurrent users", "ssl-vpn concurrent", "ssl vpn users", "scalable"],
}
SINGLE_FIREWALL = ["per firewall appliance", "minimum requirements per firewall", "perimeter firewall"]

#: Columns that the engine writes, and serial-number headers; none is part of a row's text.
OUTPUT_COLUMNS = ["References", "Hardware_Reference_Reasoning", "Reference_Match_Details"]
GUIDE_COLUMNS = ["Admin_Guide_Reference", "Admin_Guide_Reference_Reasoning"]
SERIAL_KEYS = ["sn", "sno", "srno", "serialno", "no"]

#: Products that are added if a catalog lacks them.
CURATED = [
    {
        "vendor": "Fortinet", "model": "FortiLogger", "category": "LOGGING", "product_url": "https://www.fortilogger.com/", "datasheet_url": "https://www.fortilogger.com/",
        "description": "Dedicated Fortinet-compatible hardware logging, reporting, and log backup appliance.",
        "use_case": "hardware logging solution, firewall logs, centralized logging, log reporting, log backup",
    },
    {
        "vendor": "Fortinet", "model": "FortiSwitch 1048E", "category": "DATACENTER_SWITCH", "switching_capacity_gbps": 1760, "interfaces": {"10g_sfp_plus": 48, "40g_qsfp_plus": 6},
        "management_port": True, "product_url": "https://www.fortinet.com/products/ethernet-switches/fortiswitch",
        "datasheet_url": "https://www.fortinet.com/content/dam/fortinet/assets/data-sheets/FortiSwitch_Data_Center_Series.pdf",
        "description": "FortiSwitch data-center switch family member for high-density 10G SFP+ switching requirements.",
    },
]
