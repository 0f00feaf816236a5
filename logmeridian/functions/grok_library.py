"""Grok patterns: the usual ones, those of pattern files, and their syntax rewritten for the JVM's regexes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from pathlib import Path

# Names and meanings of the usual grok patterns, written for the JVM engine.
PATTERNS = {
    "USERNAME": r"[a-zA-Z0-9._-]+",
    "USER": r"[a-zA-Z0-9._-]+",
    "EMAILLOCALPART": r"[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~]{1,64}(?:\.[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~]{1,62}){0,63}",
    "EMAILADDRESS": r"%{EMAILLOCALPART}@%{HOSTNAME}",
    "INT": r"[+-]?[0-9]+",
    "BASE10NUM": r"(?<![0-9.+-])[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)",
    "NUMBER": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)",
    "BASE16NUM": r"(?<![0-9A-Fa-f])[+-]?(?:0x)?[0-9A-Fa-f]+",
    "POSINT": r"\b[1-9][0-9]*\b",
    "NONNEGINT": r"\b[0-9]+\b",
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "QUOTEDSTRING": r"""(?:"(?:\\.|[^\\"])*+"|'(?:\\.|[^\\'])*+'|`(?:\\.|[^\\`])*+`)""",
    "QS": r"%{QUOTEDSTRING}",
    "UUID": r"[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}",
    "URN": r"urn:[0-9A-Za-z][0-9A-Za-z-]{0,31}:(?:%[0-9a-fA-F]{2}|[0-9A-Za-z()+,.:=@;$_!*'/?#-])+",
    "CISCOMAC": r"(?:[A-Fa-f0-9]{4}\.){2}[A-Fa-f0-9]{4}",
    "WINDOWSMAC": r"(?:[A-Fa-f0-9]{2}-){5}[A-Fa-f0-9]{2}",
    "COMMONMAC": r"(?:[A-Fa-f0-9]{2}:){5}[A-Fa-f0-9]{2}",
    "MAC": r"(?:%{CISCOMAC}|%{WINDOWSMAC}|%{COMMONMAC})",
    "IPV6": r"(?:(?:[0-9A-Fa-f]{1,4}:){7}(?:[0-9A-Fa-f]{1,4}|:)|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}|::(?:ffff:)?(?:[0-9]{1,3}\.){3}[0-9]{1,3}|::)(?:%\w+)?",
    "IPV4": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})",
    "IP": r"(?:%{IPV6}|%{IPV4})",
    "HOSTNAME": r"\b[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*+\.?",
    "IPORHOST": r"(?:%{IPV4}|%{HOSTNAME})",
    "HOSTPORT": r"%{IPORHOST}:%{POSINT}",
    "UNIXPATH": r"(?:/[\w_%!$@:.,+~-]*)+",
    "WINPATH": r"(?:[A-Za-z]+:|\\)(?:\\[^\\?*]*)+",
    "PATH": r"(?:%{UNIXPATH}|%{WINPATH})",
    "TTY": r"/dev/(?:pts|tty(?:[pq])?)(?:\w+)?/?(?:[0-9]+)",
    "URIPROTO": r"[A-Za-z](?:[A-Za-z0-9+\-.]+)+",
    "URIHOST": r"%{IPORHOST}(?::%{POSINT})?",
    "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%&_\-]*)+",
    "URIQUERY": r"[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\-\[\]<>]*",
    "URIPARAM": r"\?%{URIQUERY}",
    "URIPATHPARAM": r"%{URIPATH}(?:\?%{URIQUERY})?",
    "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?",
    "MONTH": r"\b(?:[Jj]an(?:uary)?|[Ff]eb(?:ruary)?|[Mm]ar(?:ch)?|[Aa]pr(?:il)?|[Mm]ay|[Jj]un(?:e)?|[Jj]ul(?:y)?|[Aa]ug(?:ust)?|[Ss]ep(?:tember)?|[Oo]ct(?:ober)?|[Nn]ov(?:ember)?|[Dd]ec(?:ember)?)\b",
    "MONTHNUM": r"(?:0?[1-9]|1[0-2])",
    "MONTHNUM2": r"(?:0[1-9]|1[0-2])",
    "MONTHDAY": r"(?:0[1-9]|[12][0-9]|3[01]|[1-9])",
    "DAY": r"(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)",
    "YEAR": r"(?:[0-9]{2}){1,2}",
    "HOUR": r"(?:2[0123]|[01]?[0-9])",
    "MINUTE": r"[0-5][0-9]",
    "SECOND": r"(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?",
    "TIME": r"(?<![0-9])%{HOUR}:%{MINUTE}(?::%{SECOND})(?![0-9])",
    "DATE_US": r"%{MONTHNUM}[/-]%{MONTHDAY}[/-]%{YEAR}",
    "DATE_EU": r"%{MONTHDAY}[./-]%{MONTHNUM}[./-]%{YEAR}",
    "DATE": r"(?:%{DATE_US}|%{DATE_EU})",
    "DATESTAMP": r"%{DATE}[- ]%{TIME}",
    "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE}))",
    "ISO8601_SECOND": r"%{SECOND}",
    "TIMESTAMP_ISO8601": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?%{ISO8601_TIMEZONE}?",
    "TZ": r"(?:[APMCE][SD]T|UTC)",
    "DATESTAMP_RFC822": r"%{DAY} %{MONTH} %{MONTHDAY} %{YEAR} %{TIME} %{TZ}",
    "DATESTAMP_RFC2822": r"%{DAY}, %{MONTHDAY} %{MONTH} %{YEAR} %{TIME} %{ISO8601_TIMEZONE}",
    "DATESTAMP_OTHER": r"%{DAY} %{MONTH} %{MONTHDAY} %{TIME} %{TZ} %{YEAR}",
    "DATESTAMP_EVENTLOG": r"%{YEAR}%{MONTHNUM2}%{MONTHDAY}%{HOUR}%{MINUTE}%{SECOND}",
    "HTTPDATE": r"[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}",
    "SYSLOGTIMESTAMP": r"[A-Z][a-z]{2} +[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}",
    "PROG": r"[\x21-\x5a\x5c\x5e-\x7e]+",
    "SYSLOGPROG": r"%{PROG:program}(?:\[%{POSINT:pid}\])?",
    "SYSLOGHOST": r"%{IPORHOST}",
    "SYSLOGFACILITY": r"<%{NONNEGINT:facility}.%{NONNEGINT:priority}>",
    "SYSLOGBASE": r"%{SYSLOGTIMESTAMP:timestamp} (?:%{SYSLOGFACILITY} )?%{SYSLOGHOST:logsource} %{SYSLOGPROG}:",
    "LOGLEVEL": r"(?:[Aa]lert|ALERT|[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo|INFO|[Ww]arn(?:ing)?|WARN(?:ING)?|[Ee]rr(?:or)?|ERR(?:OR)?|[Cc]rit(?:ical)?|CRIT(?:ICAL)?|[Ff]atal|FATAL|[Ss]evere|SEVERE|EMERG(?:ENCY)?|[Ee]merg(?:ency)?)",
    "COMMONAPACHELOG": r'%{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:timestamp}\] "(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})" %{INT:response} (?:%{INT:bytes}|-)',
    "COMBINEDAPACHELOG": r"%{COMMONAPACHELOG} %{QS:referrer} %{QS:agent}",
}

_POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s", "blank": r" \t",
    "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}", "word": r"\w", "print": r"\p{Print}", "graph": r"\p{Graph}",
}
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_CLASS_NAME = re.compile(r"\[:(\^?)(\w+):\]")


def _class(body: str) -> str:
    """A bracket expression without its brackets: names of classes and hex digits written out, what the JVM reads as set operations escaped."""
    out, i = [], 0
    if body.startswith("^"):
        out.append("^")
        i = 1
    while i < len(body):
        named, escaped = _CLASS_NAME.match(body, i), _ESCAPE.match(body, i)
        if named:
            if named[2] not in _POSIX:
                raise ValueError(f"unknown character class {named[0]}")
            inner = _POSIX[named[2]]
            out.append(f"[^{inner}]" if named[1] else inner)
            i = named.end()
        elif escaped:
            if escaped[1] == "H":
                raise ValueError(r"\H cannot stand inside brackets")
            out.append("0-9a-fA-F" if escaped[1] == "h" else escaped[0])
            i = escaped.end()
        else:
            out.append("\\" + body[i] if body[i] in "[]&" else body[i])
            i += 1
    return "".join(out)


def _class_end(pattern: str, start: int) -> int:
    """Where the bracket expression that opens at ``start`` closes; a bracket right after the opening is a letter."""
    i = start + 1
    i += pattern[i : i + 1] == "^"
    i += pattern[i : i + 1] == "]"
    while i < len(pattern) and pattern[i] != "]":
        named = _CLASS_NAME.match(pattern, i)
        i = named.end() if named else i + 2 if pattern[i] == "\\" else i + 1
    if i >= len(pattern):
        raise ValueError(f"a bracket is not closed in {pattern!r}")
    return i


def rewritten(pattern: str) -> str:
    """A pattern in the syntax of grok's own engine as the JVM reads it.

    ``\\h`` stands for a hex digit, ``[[:alpha:]]`` and its like for classes, brackets inside brackets for themselves, and a
    repetition of an optional part for a repetition. Named groups may be written ``(?<a>``, ``(?P<a>`` or ``(?'a'``, and a
    name ``[a][b]`` is that of the field ``a.b``.
    """
    out, i = [], 0
    while i < len(pattern):
        escaped = _ESCAPE.match(pattern, i)
        group = re.compile(r"\(\?(?:P?<(?![=!])([^>]+)>|'([^']+)')").match(pattern, i)
        reference = re.compile(r"%\{[^}]*\}").match(pattern, i)
        if escaped:
            out.append({"h": "[0-9a-fA-F]", "H": "[^0-9a-fA-F]"}.get(escaped[1], escaped[0]))
            i = escaped.end()
        elif reference:
            out.append(reference[0])
            i = reference.end()
        elif pattern[i] == "[":
            end = _class_end(pattern, i)
            out.append(f"[{_class(pattern[i + 1 : end])}]")
            i = end + 1
        elif group:
            out.append(f"(?<{field_name(group[1] or group[2])}>")
            i = group.end()
        elif pattern.startswith(("?*", "?+"), i):
            # Possessive repetitions of the JVM's own patterns are ``*+`` and ``++``; this is the other engine's repeated option.
            out.append("*" if pattern[i + 1] == "*" else "?+")
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def field_name(name: str) -> str:
    """``[a][b]`` as ``a.b``."""
    return ".".join(re.findall(r"\[([^\]]+)\]", name)) if name.startswith("[") else name


def parse_patterns(texts: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Patterns of ``(origin, text)`` pairs: a line holds a name and a pattern, ``#`` opens a comment.

    A name that comes again with the same pattern is no conflict; with another it is an error, as it would be unclear which
    counts.
    """
    found: dict[str, tuple[str, str]] = {}
    for origin, text in texts:
        for number, line in enumerate(text.splitlines(), 1):
            name, _, pattern = line.strip().partition(" ")
            if not name or name.startswith("#"):
                continue
            pattern = rewritten(pattern.strip())
            if not pattern:
                raise ValueError(f"{origin}:{number}: {name} has no pattern")
            before = found.setdefault(name, (pattern, f"{origin}:{number}"))
            if before[0] != pattern:
                raise ValueError(f"{name} is defined as two patterns, in {before[1]} and {origin}:{number}")
    return {name: pattern for name, (pattern, _) in found.items()}


def load_patterns(folder: str, overlay: str | None = None, base: Mapping[str, str] = PATTERNS) -> dict[str, str]:
    """``base``, then the pattern files of ``folder``, then those of ``overlay`` in front of both."""

    def read(path: str) -> dict[str, str]:
        skipped = {".md", ".txt", ".yaml", ".yml", ".json"}
        files = [f for f in sorted(Path(path).rglob("*")) if f.is_file() and not f.name.startswith(".") and f.suffix not in skipped and f.name != "LICENSE"]
        return parse_patterns((str(f), f.read_text("utf-8")) for f in files)

    return {**base, **read(folder), **(read(overlay) if overlay and Path(overlay).is_dir() else {})}
