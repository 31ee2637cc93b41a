"""Time formats written with percent signs, as Java patterns."""

from __future__ import annotations

#: Directives and the Java pattern letters of the same meaning.
_JAVA = {
    "Y": "yyyy",
    "y": "yy",
    "m": "MM",
    "d": "dd",
    "e": "d",
    "H": "HH",
    "I": "hh",
    "M": "mm",
    "S": "ss",
    "p": "a",
    "j": "DDD",
    "b": "MMM",
    "h": "MMM",
    "B": "MMMM",
    "a": "E",
    "A": "EEEE",
    "f": "SSSSSS",
    "3f": "SSS",
    "6f": "SSSSSS",
    ".3f": ".SSS",
    ".6f": ".SSSSSS",
    "z": "xx",
    ":z": "xxx",
    "Z": "VV",
    "F": "yyyy-MM-dd",
    "T": "HH:mm:ss",
    "R": "HH:mm",
    "D": "MM/dd/yy",
    "%": "%",
    "n": "\n",
    "t": "\t",
}


def java_pattern(format: str) -> str:
    """The Java pattern of a format; ValueError for directives that have none."""
    out, i, text = [], 0, ""

    def flush():
        nonlocal text
        if text:
            plain = text.replace("'", "''")
            out.append(f"'{plain}'" if any(c.isalpha() or c in "'[]{}#" for c in text) else plain)
            text = ""

    while i < len(format):
        c = format[i]
        if c != "%":
            text += c
            i += 1
            continue
        for n in (3, 2, 1):
            name = format[i + 1 : i + 1 + n]
            if len(name) == n and name in _JAVA:
                if name in ("%", "n", "t"):
                    text += _JAVA[name]
                else:
                    flush()
                    out.append(_JAVA[name])
                i += 1 + n
                break
        else:
            raise ValueError(f"unsupported time format {format!r} at {format[i : i + 2]!r}")
    flush()
    return "".join(out)


def has_offset(format: str) -> bool:
    return any(d in format.replace("%%", "") for d in ("%z", "%:z", "%Z"))
