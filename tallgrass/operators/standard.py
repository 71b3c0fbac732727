"""Sets and predicates that every rule may use. A predicate takes the alias of an event, or fields of it, and gives a condition."""

from __future__ import annotations

from tallgrass.functions.numeric import duration_ms
from tallgrass.operators.conditions import Condition, Expression, field

#: The standard sets: fixed values.
SHELLS = ["bash", "sh", "zsh", "fish", "dash", "tcsh", "python3", "python", "perl", "ruby", "node", "php", "powershell", "pwsh", "cmd.exe"]
WEB_SERVERS = ["nginx", "apache2", "httpd", "lighttpd", "gunicorn", "uvicorn", "caddy", "haproxy", "envoy", "traefik"]
DB_SERVERS = ["postgres", "mysqld", "mongod", "redis-server", "cassandra", "elasticsearch", "clickhouse-server"]
RECON_TOOLS = ["nmap", "masscan", "ncrack", "hydra", "medusa", "nuclei", "gobuster", "ffuf", "nikto", "sqlmap"]
EXFIL_TOOLS = ["curl", "wget", "nc", "netcat", "socat", "rclone", "rsync", "scp", "ftp", "tftp"]
SENSITIVE_PROCS = ["lsass.exe", "winlogon.exe", "csrss.exe", "svchost.exe", "gpg-agent", "ssh-agent", "gpg", "pass"]
CREDENTIAL_PATHS = [
    "/etc/shadow", "/etc/passwd", "/etc/sudoers", "~/.aws/credentials", "~/.aws/config", "~/.ssh/id_rsa", "~/.ssh/id_ed25519", "~/.ssh/authorized_keys", "~/.gnupg/", "/proc/*/mem", "/proc/*/maps",
]
SENSITIVE_DIRS = ["/etc", "/root", "/proc/1", "/sys/kernel", "/var/shadow", "C:\\Windows\\System32\\config"]
TMP_DIRS = ["/tmp", "/var/tmp", "/dev/shm", "/run/shm", "C:\\Windows\\Temp", "C:\\Users\\Public"]
C2_PORTS = [4444, 4445, 1337, 31337, 8081, 8082, 9001, 1080]
WELL_KNOWN_PORTS = [80, 443, 22, 21, 25, 53, 110, 143, 389, 636, 3306, 5432, 6379, 27017, 9200, 8080, 8443]
MALICIOUS_REPUTATION = ["malicious", "known_bad", "blacklisted"]
SUSPICIOUS_REPUTATION = ["suspicious", "unknown", "newly_registered"]
BAD_REPUTATION = ["malicious", "suspicious", "known_bad", "blacklisted"]
APPROVED_DEBUG_IMAGES = ["busybox", "alpine", "ubuntu", "debian", "toolbox/debug"]
SENSITIVE_LABELS = ["crown_jewel", "critical", "sensitive"]


def _of(alias: str, name: str) -> Expression:
    return field(f"{alias}.{name}")


def is_shell(process: str) -> Condition:
    return _of(process, "name").is_in(SHELLS)


def from_tmp(process: str) -> Condition:
    return _of(process, "filename").under(TMP_DIRS)


def unsigned_from_tmp(process: str) -> Condition:
    return from_tmp(process) & (_of(process, "signed") == False)  # noqa: E712


def privileged_shell(process: str) -> Condition:
    return is_shell(process) & (_of(process, "uid") == 0)


def living_off_the_land(process: str) -> Condition:
    name = _of(process, "name")
    return name.is_in(RECON_TOOLS) | name.is_in(EXFIL_TOOLS) | (name.is_in(SHELLS) & ~_of(process, "parent.name").is_in(WEB_SERVERS))


def external_c2(endpoint: str) -> Condition:
    outside = _of(endpoint, "is_internal") == False  # noqa: E712
    return outside & (_of(endpoint, "port").is_in(C2_PORTS) | _of(endpoint, "reputation").is_in(MALICIOUS_REPUTATION))


def unexpected_external(endpoint: str, host_domains: Expression) -> Condition:
    """host_domains: the domains of the host's baseline, as callables.call("host", id) has them."""
    return (_of(endpoint, "is_internal") == False) & ~_of(endpoint, "domain").is_in(host_domains)  # noqa: E712


def sensitive_file(file: str) -> Condition:
    return _of(file, "path").is_in(CREDENTIAL_PATHS) | _of(file, "sensitivity_label").is_in(SENSITIVE_LABELS)


def credential_access(process: str, file: str) -> Condition:
    return sensitive_file(file) & (_of(process, "uid") != _of(file, "expected_reader_uid"))


def unusual(value: Expression, known: Expression) -> Condition:
    """Not in the baseline: a country, a host or an hour of a user, say."""
    return ~value.is_in(known)


def impossible_travel(country: Expression, countries: Expression, last_country: Expression, ts_ms: Expression, last_ms: Expression) -> Condition:
    return unusual(country, countries) & (last_country != country) & ((ts_ms - last_ms) < duration_ms("2h"))
