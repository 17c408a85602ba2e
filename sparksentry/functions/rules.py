"""Rule detectors as data, and the Column builders that read verdicts and reasons from them."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_ascii, percent_decode

# The signature rules, by family.
SQLI_RULES = {
    "union_select": r"\bunion\b.{0,40}\bselect\b",
    "or_1_eq_1": r"\bor\b\s+1\s*=\s*1",
    "quote_or_number": r"""('|")\s*or\s*('|")?\d+\s*=\s*\d+""",
    "comment_at_end": r"(--|#)\s*$",
    "drop_table": r"\bdrop\b\s+\btable\b",
    "select_from": r"\bselect\b.{0,40}\bfrom\b",
    "sleep_call": r"\bsleep\s*\(",
    "exec_shell": r"\bexec\b\s+\bxp_cmdshell\b",
    "information_schema": r"\binformation_schema\b",
    "semicolon_comment": r";\s*--",
    "having_number": r"\bhaving\b\s+\d+\s*=\s*\d+",
}
XSS_RULES = {
    "script_tag": r"<\s*script\b",
    "event_alert": r"""on\w+\s*=\s*['"]?\s*alert\s*\(""",
    "javascript_scheme": r"javascript\s*:",
    "img_onerror": r"<\s*img\b[^>]*\bonerror\b",
    "svg_onload": r"<\s*svg\b[^>]*\bonload\b",
    "iframe_tag": r"<\s*iframe\b",
    "document_cookie": r"document\.cookie",
    "body_onload": r"<\s*body\b[^>]*\bonload\b",
}
# User agents of scanners, those of common libraries apart.
SCANNER_AGENTS = ["sqlmap", "Nikto", "Nuclei", "wpscan", "dalfox", "XSStrike", "wafw00f", "WhatWeb", "Hydra", "dirsearch", "gobuster", "feroxbuster", "ffuf", "HexStrike-HTTP-Framework", "Compatible Exploit", "masscan", "Nessus", "OpenVAS", "acunetix", "Qualys"]
LIBRARY_AGENTS = ["^python-requests", "^curl/"]
# Paths that only reconnaissance asks for.
SENSITIVE_PATHS = [r"/\.git(/|$)", r"/\.env(\.|$)", r"/\.svn(/|$)", r"/\.hg(/|$)", r"wp-config\.php", r"/\.htpasswd", r"/\.htaccess", r"id_rsa", r"/\.aws/credentials", r"/\.ssh/", r"/phpinfo\.php", r"/config\.php\.(bak|swp|old|orig)", r"/backup\.(zip|sql|tar\.gz|tar)", r"/\.DS_Store", r"/server-status", r"/\.well-known/(?!security\.txt)", r"/xmlrpc\.php", r"/\.idea/", r"/\.vscode/"]
# Headers by which a client claims another address, and headers whose text is inspected.
FORWARDING_HEADERS = ["x-forwarded-for", "x-real-ip", "x-originating-ip", "x-client-ip"]
INSPECTED_HEADERS = ["user-agent", "referer", "cookie", "x-forwarded-for"]

#: Case-insensitive, Unicode classes, and only \n ends a line.
_FLAGS = "(?iUd)"


def any_of(patterns: list[str], flags: str = _FLAGS) -> str:
    return flags + "|".join(f"(?:{p})" for p in patterns)


#: Strings of which an ASCII text holds one, in lower case, if a rule of the family matches; in a group, all of them.
SQLI_MARKS = [["union", "select"], ["or", "="], ["--"], ["#"], ["drop"], ["select", "from"], ["sleep"], ["xp_cmdshell"], ["information_schema"], ["having", "="]]
XSS_MARKS = [["<", "script"], ["alert"], ["javascript"], ["<", "img"], ["<", "svg"], ["iframe"], ["document.cookie"], ["<", "body"]]


def _matches(text: Column, rules: dict[str, str], marks: list[list[str]]) -> Column:
    """Whether a rule matches; the patterns only see texts that hold a mark, and Unicode classes only texts that need them."""

    def marked(lower: Column) -> Column:
        groups = [reduce(and_, [lower.contains(m) for m in group]) for group in marks]
        return reduce(or_, groups)

    patterns = list(rules.values())
    # in an array of one, so that the text is lower-cased once
    ascii_hit = F.exists(F.array(F.lower(text)), marked) & text.rlike(any_of(patterns, "(?id)"))
    return F.when(is_ascii(text), ascii_hit).otherwise(text.rlike(any_of(patterns)))


def signature(text: Column) -> Column:
    """'sqli', else 'xss', else 'benign'; null for null."""
    sqli, xss = _matches(text, SQLI_RULES, SQLI_MARKS), _matches(text, XSS_RULES, XSS_MARKS)
    return F.when(text.isNull(), F.lit(None).cast("string")).when(sqli, "sqli").when(xss, "xss").otherwise("benign")


def signature_hits(text: Column) -> Column:
    """family/rule names that match, in the order of the rules."""
    rules = [("sqli", k, p) for k, p in SQLI_RULES.items()] + [("xss", k, p) for k, p in XSS_RULES.items()]
    return F.array_compact(F.array(*(F.when(text.rlike(_FLAGS + p), F.lit(f"{family}/{name}")) for family, name, p in rules)))


def anomaly_reasons(text: Column, max_length: int = 2048, max_percent: float = 0.35, max_special: float = 0.5, min_length: int = 20) -> Column:
    n = F.length(text)
    percent = F.regexp_count(text, F.lit("%[0-9A-Fa-f]{2}")) * 3 / n
    special = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")) / n
    long_enough = n >= min_length
    return F.array_compact(
        F.array(
            F.when(n > max_length, F.concat(F.lit("length="), n.cast("string"), F.lit(f">{max_length}"))),
            F.when(long_enough & (percent > max_percent), F.format_string("percent_encoded_ratio=%.2f", percent)),
            F.when(long_enough & (special > max_special), F.format_string("special_char_ratio=%.2f", special)),
        )
    )


def anomaly(text: Column, max_length: int = 2048, max_percent: float = 0.35, max_special: float = 0.5, min_length: int = 20) -> Column:
    """anomalous for a text with a reason; the cheapest ones are looked at first, and no more than needed."""
    n = F.length(text)
    # escapes are at most as many as percent signs
    signs = n - F.length(F.replace(text, F.lit("%")))
    percent = (signs * 3 / n > max_percent) & (F.regexp_count(text, F.lit("%[0-9A-Fa-f]{2}")) * 3 / n > max_percent)
    special = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")) / n > max_special
    return F.when(text.isNull(), F.lit(None).cast("string")).when(n > max_length, "anomalous").when(n < min_length, "benign").when(percent, "anomalous").when(special, "anomalous").otherwise("benign")


def agent_reason(agent: Column) -> Column:
    scanner, library = agent.rlike(any_of(SCANNER_AGENTS, "(?i)")), agent.rlike(any_of(LIBRARY_AGENTS, "(?i)"))
    return F.when(scanner, F.concat(F.lit("scanner_user_agent:"), F.left(agent, F.lit(60)))).when(library, F.concat(F.lit("low_confidence_ua:"), F.left(agent, F.lit(40))))


def path_of(rel_url: Column) -> Column:
    """A URL's path, without query and fragment."""
    return F.regexp_extract(rel_url, "^[^?#]*", 0)


def path_reason(path: Column) -> Column:
    return F.when(path.rlike(any_of(SENSITIVE_PATHS, "(?i)")), F.concat(F.lit("sensitive_path:"), F.left(path, F.lit(80))))


def spoof_reasons(headers: Column, direct_ip: Column, trusted: list[str]) -> Column:
    """headers: map from lower-case name to value."""
    shown = {"x-forwarded-for": "X-Forwarded-For", "x-real-ip": "X-Real-IP", "x-originating-ip": "X-Originating-IP", "x-client-ip": "X-Client-IP"}
    claims = F.array_compact(F.array(*(F.when(headers[h].isNotNull(), F.concat(F.lit(f"spoofed_forwarding_header:{shown[h]}="), F.left(headers[h], F.lit(40)))) for h in FORWARDING_HEADERS)))
    return F.when(F.coalesce(direct_ip, F.lit("unknown")).isin(*trusted), F.array().cast("array<string>")).otherwise(claims)


def recon(path: Column, headers: Column, direct_ip: Column, trusted: list[str]) -> Column:
    """struct(flagged, reasons); a low-confidence agent alone doesn't flag."""
    reasons = F.concat(F.array_compact(F.array(agent_reason(headers["user-agent"]), path_reason(path))), spoof_reasons(headers, direct_ip, trusted))
    return F.struct(F.exists(reasons, lambda r: ~r.startswith("low_confidence_ua:")).alias("flagged"), reasons.alias("reasons"))


def integrity_reason(lengths: Column, encodings: Column) -> Column:
    """Why the framing headers (arrays of values, null: absent) are ambiguous; null if they aren't."""
    lengths, encodings = (F.coalesce(x, F.array().cast("array<string>")) for x in (lengths, encodings))
    bad_length = F.filter(lengths, lambda x: ~F.trim(x).rlike("^[0-9]+$"))
    bad_encoding = F.filter(encodings, lambda x: F.lower(F.trim(x)) != "chunked")
    return (
        F.when(F.size(F.array_distinct(lengths)) > 1, F.concat(F.lit("conflicting Content-Length headers: "), F.array_join(F.array_sort(F.array_distinct(lengths)), ",")))
        .when(F.size(bad_length) > 0, F.concat(F.lit("malformed Content-Length: "), bad_length[0]))
        .when((F.size(lengths) > 0) & (F.size(encodings) > 0), F.lit("both Content-Length and Transfer-Encoding present"))
        .when(F.size(bad_encoding) > 0, F.concat(F.lit("unsupported/malformed Transfer-Encoding: "), bad_encoding[0]))
    )


def websocket_upgrade(connection: Column, upgrade: Column) -> Column:
    return F.coalesce(F.lower(connection).contains("upgrade") & F.lower(upgrade).contains("websocket"), F.lit(False))


_IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
_GROUP = "[0-9A-Fa-f]{1,4}"
_V4 = _IPV4[1:-1]


def is_ip(text: Column) -> Column:
    """IPv4, or IPv6 with at most one '::', an IPv4 tail or a zone; all JVM-side."""
    base = F.regexp_replace(text, "%[^%]+$", "")
    v6 = F.regexp_replace(base, _V4 + "$", "0:0")
    groups = F.size(F.filter(F.split(v6, ":"), lambda g: g != ""))
    shaped = v6.rlike(f"^(({_GROUP})(:{_GROUP})*)?(::)?(({_GROUP})(:{_GROUP})*)?$") & v6.contains(":")
    packed = v6.contains("::") & (groups <= 7)
    full = ~v6.contains("::") & (groups == 8)
    return F.coalesce(text.rlike(_IPV4) | (shaped & (packed | full)), F.lit(False))


def client_ip(remote: Column, forwarded: Column, trusted: list[str]) -> Column:
    """The first forwarded address if a trusted proxy sent it and it is one, else the peer's, else 'unknown'."""
    peer = F.coalesce(remote, F.lit("unknown"))
    claimed = F.trim(F.split(forwarded, ",")[0])
    return F.when(peer.isin(*trusted) & is_ip(claimed), claimed).otherwise(peer)


def header_texts(headers: Column) -> Column:
    return F.filter(F.array(*(headers[h] for h in INSPECTED_HEADERS)), lambda x: x.isNotNull() & (x != ""))


def inspectable_texts(path_qs: Column, body: Column, content_type: Column) -> Column:
    """The decoded URL, and the body if there is one (decoded if it is a form)."""
    shown = F.when(F.coalesce(F.lower(content_type), F.lit("")).contains("application/x-www-form-urlencoded"), percent_decode(body)).otherwise(body)
    return F.array_compact(F.array(percent_decode(path_qs), F.when(F.coalesce(F.length(body), F.lit(0)) > 0, shown)))
