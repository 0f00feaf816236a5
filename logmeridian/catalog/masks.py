r"""Mask dictionary (fixed values).

Each entry is ``(name, regex, quick)``. Masks run in this order and replace every match by
``<NAME>``; regexes run with Unicode character classes. ``quick`` lists alternatives, each a set of
``(literal, count)`` that a body must hold for the regex to be able to match (with count 0, a cheap regex); it
only saves work.

The regexes are written for the JVM engine: a leading boundary is tested after the first characters
(a look-behind at every position is what costs most), and repeated groups are possessive or bounded,
because every other group loop recurses and a stack overflow in a task takes its executor down. The
host name bound is three times what DNS allows.
"""

MASKS = (
    (
        "TIMESTAMP_ISO8601",
        r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?",
        ((("-", 2), (":", 2)),),
    ),
    (
        "UUID",
        r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b",
        ((("-", 4),),),
    ),
    ("MAC", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", (((":", 5),), (("-", 5),), ((":", 1), ("-", 1)))),
    (
        "IPV6",
        r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}"
        r"|(?:[0-9A-Fa-f]{1,4}:){1,7}:"
        r"|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:.])",
        ((("::", 1),), ((":", 7),)),
    ),
    ("URI", r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s\"<>]+", ((("://", 1),),)),
    ("EMAILADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", ((("@", 1),),)),
    (
        "IPV4",
        r"\d{1,3}+\.(?<=(?<![\w.])\d{1,3}\.)(?:\d{1,3}+\.){2}\d{1,3}+(?![\w.])",
        (((".", 3),),),
    ),
    ("WINPATH", r"\b[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n ]+\\?)++", (((":\\", 1),),)),
    ("UNIXPATH", r"(?:/[\w.%!$@:,+~-]+){2,}+/?", ((("/", 2),),)),
    (
        "HOSTNAME",
        r"[0-9A-Za-z](?<!\w.)(?=[0-9A-Za-z-]*+\.)(?:[0-9A-Za-z-]{0,61}[0-9A-Za-z])?\."
        r"(?:[0-9A-Za-z](?:[0-9A-Za-z-]{0,61}[0-9A-Za-z])?\.){0,400}[A-Za-z]{2,}\b",
        (((r"\.[A-Za-z]{2}", 0),),),
    ),
    ("BASE16NUM", r"0(?<![\w.].)[xX][0-9A-Fa-f]++(?![\w.])", ((("0x", 1),), (("0X", 1),))),
    ("NUMBER", r"[+\-\d](?<![\w.].)(?:(?<=\d)|\d)\d*+(?:\.\d++)?+(?![\w.])", ()),
)

MASK_NAMES = tuple(name for name, _, _ in MASKS)
