"""The pattern catalogue, as Python regular expressions, and their translation for Spark."""

from __future__ import annotations

import re

# Names, patterns and placeholders of the log format this engine reads and writes.
ANONYMIZATION = {
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ipv6_address": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "mac_address": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "url": r'https?://[^\s<>"{}|\^`\[\]\\]+',
    "file_path": r'(?:/[^\s<>"{}|\^`\[\]\\]+)+',
    "timestamp": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    "date": r"\d{4}-\d{2}-\d{2}",
    "time": r"\d{2}:\d{2}:\d{2}(?:\.\d+)?",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "hex_id": r"0x[0-9a-fA-F]+",
    "unix_timestamp": r"\b\d{10,19}\b",
    "numeric_hash": r"\b\d{32,64}\b",
    "hostname": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "device_id": r"\b[A-Z]{2,}[A-Z0-9]{8,}\b",
    "device_name": r"\b(?:mg-|dev-|prod-|test-)[a-zA-Z0-9_-]+\b",
    "fortinet_device": r"\bFGT[A-Z0-9]{12,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "version": r"\b(?:v?)?\d+\.\d+(?:\.\d+)?(?:-[a-zA-Z0-9]+)?\b",
    "hash_string": r"\b(?:hash|sha1|sha256|md5|checksum|fingerprint|digest)\s*[:=]\s*[a-fA-F0-9]{32,64}\b",
    "user_identifier": r"\b(?:user_id|userid|uid|user|username)\s*[:=]\s*\d{6,}\b",
    "generic_timestamp": r"\b(?<!<)(?<!>)\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?!>)\b",
    "system_id": r"\b(?:id|seq|pid|tid|uid|gid|sid|rid|aid|bid|cid|did|eid|fid|gid|hid|iid|jid|kid|lid|mid|nid|oid|pid|qid|rid|sid|tid|uid|vid|wid|xid|yid|zid)\s*=\s*\d{5,}\b",
    "domain": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b",
    "port_number": r":(6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]|[1-5]?[0-9]{1,4}|[1-9][0-9]{1,3}|[1-9][0-9]{2}|[1-9][0-9]|[1-9])\b",
    "hostname_port": r"([a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}:(6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]|[1-5]?[0-9]{1,4}|[1-9][0-9]{1,3}|[1-9][0-9]{2}|[1-9][0-9]|[1-9])\b",
}
# Patterns that only detect; those of the other names are the same as above.
DETECTION = {
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "numeric_id": r"\b\d{5,}\b",
    "sequence": r"\b\d{10,}\b",
    "path": r"(?:/[^/\s]+)+",
} | {
    name: ANONYMIZATION[name]
    for name in ("mac_address", "unix_timestamp", "email", "credit_card", "ssn", "phone", "uuid", "hex_id", "hostname", "domain", "version", "url", "device_id", "device_name", "fortinet_device", "port_number", "hostname_port")
}
# Ports of services.
PORTS = {
    "http": 80, "https": 443, "ssh": 22, "ftp": 21, "smtp": 25, "dns": 53, "dhcp": 67, "ntp": 123, "snmp": 161, "ldap": 389,
    "mysql": 3306, "postgres": 5432, "redis": 6379, "mongodb": 27017, "elasticsearch": 9200, "kibana": 5601, "grafana": 3000, "prometheus": 9090,
}
# Line formats with named groups, in the order in which they are tried.
PARSING = {
    "apache_clf": r'^(?P<ip>\S+) \S+ \S+ \[(?P<timestamp>[^\]]+)\] "(?P<request>[^"]*)" (?P<status>\d+) (?P<bytes>\S+)',
    "apache_combined": r'^(?P<ip>\S+) \S+ \S+ \[(?P<timestamp>[^\]]+)\] "(?P<request>[^"]*)" (?P<status>\d+) (?P<bytes>\S+) "(?P<referer>[^"]*)" "(?P<user_agent>[^"]*)"',
    "syslog": r"^(?P<timestamp>\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(?P<hostname>\S+)\s+(?P<process>\S+)\[(?P<pid>\d+)\]:\s+(?P<message>.*)$",
    "fortinet": r"^(?P<timestamp>\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+(?P<device_id>\S+)\s+(?P<type>\S+)\s+(?P<subtype>\S+)\s+(?P<level>\S+)\s+(?P<message>.*)$",
}
# Columns by which families of CSV files are known, and how many of them must be there.
CSV_FAMILIES = {
    "loghub": (["LineId", "EventId", "EventTemplate", "Content", "Component", "Pid", "Time", "Timestamp"], 3),
    "cybersecurity": (["Event ID", "Timestamp", "Source IP", "Destination IP", "User Agent", "Attack Type", "Attack Severity", "Data Exfiltrated", "Threat Intelligence", "Response Action"], 5),
    "intrusion_data": (["session_id", "network_packet_size", "protocol_type", "login_attempts", "session_duration", "encryption_used", "ip_reputation_score", "failed_logins", "browser_type", "unusual_time_access", "attack_detected"], 5),
}
# Placeholders by their names.
PLACEHOLDERS = {
    "ip": "<IP>", "mac": "<MAC>", "email": "<EMAIL>", "timestamp": "<TIMESTAMP>", "date": "<DATE>", "time": "<TIME>",
    "version": "<VERSION>", "path": "<FILE_PATH>", "url": "<URL>", "devid": "<DEVICE_ID>", "devname": "<DEVICE_NAME>",
    "hostname": "<HOSTNAME>", "tz": "<TIMEZONE>", "vd": "<VD>", "numeric_id": "<NUMERIC_ID>", "hash": "<HASH>", "uuid": "<UUID>", "num": "<NUM>",
}
#: The placeholder of each pattern that has a configured one; other patterns are replaced by their own names.
PLACEHOLDER_OF = {
    "ip_address": "ip", "ipv6_address": "ip", "mac_address": "mac", "email": "email", "timestamp": "timestamp", "generic_timestamp": "timestamp", "unix_timestamp": "timestamp",
    "date": "date", "time": "time", "version": "version", "file_path": "path", "url": "url", "device_id": "devid", "fortinet_device": "devid", "device_name": "devname",
    "hostname": "hostname", "domain": "hostname", "system_id": "numeric_id", "numeric_hash": "hash", "hash_string": "hash", "uuid": "uuid", "hex_id": "num",
}
# Fixed value: the salt of hashed fields.
FIELD_SALT = "clean_parser_salt_2024"
# The fields that are always anonymized, those of them that are hashed or masked, and the mask.
ALWAYS_ANONYMIZE = (
    "ip_address", "user_id", "session_id", "device_id", "mac_address", "email", "phone", "credit_card", "ssn", "path",
    "srcip", "dstip", "ip", "devname", "hostname", "device_name", "fortinet_device", "filename", "source_file", "vd",
)
HASHED_FIELDS = ("user_id", "session_id", "device_id")
MASKED_FIELDS = ("credit_card", "ssn", "phone")
FIELD_MASK = "***"
#: The placeholder of each other field.
FIELD_PLACEHOLDERS = {
    "ip_address": "ip", "srcip": "ip", "dstip": "ip", "ip": "ip", "mac_address": "mac", "email": "email", "path": "path", "filename": "path", "source_file": "path",
    "devname": "devname", "device_name": "devname", "hostname": "hostname", "fortinet_device": "devid", "vd": "vd",
}
# What cleans a time of the form month-day,time.
TIMESTAMP_CLEAN = r"(\d{2}-\d{2}),(\d{2}:\d{2}:\d{2}\.\d+)"
# The kinds of fields by words of their names, all of confidence 0.9.
FIELD_NAMES = {
    "timestamp": ["timestamp", "time", "date", "datetime"],
    "ip_address": ["ip", "srcip", "dstip", "source_ip", "dest_ip"],
    "user_id": ["user_id", "userid", "uid", "user"],
    "process_id": ["pid", "process_id", "processid"],
    "port": ["port", "port_number"],
    "message": ["message", "content", "msg", "log"],
    "level": ["level", "severity", "priority"],
    "component": ["component", "service", "module", "class"],
    "hostname": ["hostname", "host", "server"],
    "url": ["url", "uri", "link"],
    "path": ["path", "filepath", "directory"],
    "email": ["email", "mail", "e-mail"],
    "hash": ["hash", "sha1", "sha256", "md5", "checksum"],
}
NAME_CONFIDENCE = 0.9
# The kinds of fields by their values, in the order in which they are tried.
FIELD_VALUES = {
    "timestamp": [r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}", r"\d{2}:\d{2}:\d{2}", r"\d{8}-\d{2}:\d{2}:\d{2}:\d{3}"],
    "ip_address": [r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"],
    "user_id": [r"\b\d{6,}\b", r"[a-zA-Z0-9_]{3,20}"],
    "process_id": [r"\b\d{1,5}\b"],
    "port": [r"\b\d{1,5}\b"],
    "hash": [r"\b[a-fA-F0-9]{32,64}\b"],
    "email": [r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"],
}


def port_pattern(service: str) -> str:
    return rf":{PORTS[service]}\b"


#: The ports of services by name, as patterns.
SERVICE_PORTS = {f"{service}_port": port_pattern(service) for service in PORTS}


def to_java(pattern: str) -> tuple[str, list[str]]:
    """The pattern for Spark (Unicode classes, numbered groups) and the names of its groups by number ('' if none)."""
    names: list[str] = []
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "(" and not in_class:
            named = re.match(r"\(\?P<(\w+)>", pattern[i:])
            if named:
                names.append(named[1])
                out.append("(")
                i += named.end()
                continue
            if not pattern.startswith("(?", i):
                names.append("")
        out.append(c)
        i += 1
    return "(?U)" + "".join(out), names
