"""Fixed values of the oracles, written out apart from the engine's: a changed pattern, marker or list
on either side shows as a differing row."""

from __future__ import annotations

import ipaddress

# ---------------------------------------------------------------------------
# Patterns (RE2), month and severity names, white space, markers, networks, risks.
OPENSSH_PREFIX = (
    r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[]+)\[(\d+)\]:\s+(.*)$"
)
SSH_LINE = r"^(\w+)\s+(\d+)\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\w+)(?:\[(\d+)\])?:\s+(.+)$"
SSH_FAIL = r"Failed (\S+) for (?:invalid user )?(\S+) from ([\d.]+)"
SSH_ACCEPT = r"Accepted (\S+) for (\S+) from ([\d.]+)"
SSH_DISCONNECT = r"Received disconnect from ([\d.]+)"
SSH_DETECT = r"^\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2}"
SYSLOG_LINE = (
    r"^<(\d+)>(\d)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.+)$"
)
WINDOWS_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\s+(\w+)\s+([^\s]+)\s+(\d+)\s+(.+)$"
ISO_DATETIME = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})"
LEVEL_WORD = r"(?i)\b(DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|CRIT(?:ICAL)?|ALERT|EMERG(?:ENCY)?)\b"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SYSLOG_SEVERITY = ["EMERG", "ALERT", "CRIT", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG"]
SSH_ERROR_WORDS = ["Failed", "error", "Invalid", "illegal"]
PY_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CRITICAL_MARKERS = ["possible break-in attempt", "too many authentication failures"]
ERROR_MARKERS = [
    "failed password", "authentication failure", "fatal", "error", "invalid user", "user unknown",
]
WARNING_MARKERS = ["disconnect", "closed by", "preauth", "reverse mapping"]
BOGON_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8",
    "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "240.0.0.0/4", "255.255.255.255/32",
]
PRIVATE_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]
PRIVATE_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
LOOPBACK_NETWORK = "127.0.0.0/8"
MULTICAST_NETWORK = "224.0.0.0/4"
IPV4_TOKEN = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
DOMAIN_TOKEN = r"\b([a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
HIGH_RISK = 0.5
RISK_PUBLIC = 0.3
RISK_SUSPICIOUS_BOGON = 0.7
STRICT_IPV4 = r"^(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$"
# ---------------------------------------------------------------------------


def bounds(cidr: str) -> tuple[int, int]:
    """First and last address of a block, as numbers."""
    net = ipaddress.ip_network(cidr)
    return int(net[0]), int(net[-1])
