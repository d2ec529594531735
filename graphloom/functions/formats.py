"""Patterns of `format`, and the change from the query language's regular expressions to Java's."""

from __future__ import annotations

import re

from ..errors import InvalidRegularExpression

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_H16 = r"[0-9A-Fa-f]{1,4}"


def _ipv6() -> str:
    """Eight groups, or fewer around one double colon; an IPv4 address may take the last two."""
    end = rf"(?:{_H16}:{_H16}|{_IPV4})"
    forms = [rf"(?:{_H16}:){{6}}{end}"]
    for left in range(8):
        before = rf"(?:{_H16}(?::{_H16}){{0,{left - 1}}})?" if left else ""
        right = 7 - left
        if right >= 2:
            forms.append(rf"{before}::(?:(?:{_H16}:){{0,{right - 2}}}{end}|{_H16})?")
        elif right == 1:
            forms.append(rf"{before}::{_H16}?")
        else:
            forms.append(rf"{before}::")
    return "|".join(forms)


_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_DATE = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)(?:\.[0-9]+)?"
_PERCENT = r"%[0-9A-Fa-f]{2}"


def _uri_template() -> str:
    """RFC 6570: literals, and expressions of an operator and comma-separated variables with a prefix length or a star."""
    literal = rf"(?:[^\x00-\x20\"'%<>\\^`{{|}}]|{_PERCENT})"
    character = rf"(?:\w|{_PERCENT})"
    name = rf"{character}(?:\.?{character})*"
    variable = rf"{name}(?::[1-9][0-9]{{0,3}}|\*)?"
    operator = "|".join(map(re.escape, "+#./;?&=,!@|"))
    return rf"(?:{literal}|\{{(?:{operator})?{variable}(?:,{variable})*\}})*"


_URI_CHARS = r"(?:[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=]|%[0-9A-Fa-f]{2})"

FORMATS = {
    "date-time": rf"{_DATE}[Tt ]{_TIME}(?:[Zz]|[+-][0-9]{{2}}(?::?[0-9]{{2}})?)",
    "date": _DATE,
    "time": rf"{_TIME}(?:[Zz]|[+-][0-9]{{2}}:?[0-9]{{2}})?",
    "email": rf"[A-Za-z0-9.!#$%&'*+/=?^_`{{|}}~-]+@{_LABEL}(?:\.{_LABEL})*",
    "hostname": rf"(?=.{{1,253}}$){_LABEL}(?:\.{_LABEL})*",
    "ipv4": _IPV4,
    "ipv6": _ipv6(),
    "uri": rf"[A-Za-z][A-Za-z0-9+.-]*:{_URI_CHARS}+",
    "uri-reference": rf"{_URI_CHARS}*",
    "uri-template": _uri_template(),
    "json-pointer": r"(?:/(?:[^~/]|~0|~1)*)*",
    "uuid": r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-4[0-9A-Fa-f]{3}-[89ABab][0-9A-Fa-f]{3}-[0-9A-Fa-f]{12}",
}
FORMATS = {name: rf"\A(?:{pattern})\z" for name, pattern in FORMATS.items()}

_CLASSES = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}"}


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """An unanchored pattern for rlike: `$` is the end of the text only, classes like [:alpha:] and word edges are spelled out."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            out.append({"y": r"\b", "Y": r"\B", "m": r"\b(?=\w)", "M": r"\b(?<=\w)", "Z": r"\z"}.get(nxt, c + nxt) if not in_class else c + nxt)
            i += 2
            continue
        if in_class:
            found = re.match(r"\[:(\w+):\]", pattern[i:])
            if found:
                if found[1] not in _CLASSES:
                    raise InvalidRegularExpression(f"unknown character class {found[1]}")
                out.append(_CLASSES[found[1]])
                i += len(found[0])
                continue
            if c == "[":
                c = r"\["
            in_class = c != "]"
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "]" or pattern[i + 1 : i + 3] == "^]":
                # A bracket that comes first stands for itself.
                lead = "[^\\]" if pattern[i + 1] == "^" else "[\\]"
                out.append(lead)
                i += 2 + (pattern[i + 1] == "^")
                continue
        elif c == "$":
            c = r"\z"
        out.append(c)
        i += 1
    if in_class:
        raise InvalidRegularExpression(f"brackets do not match: {pattern}")
    text = "".join(out)
    check = re.sub(r"\\p\{\w+\}", "a", text).replace(r"\z", r"\Z")
    try:
        re.compile(check)
    except re.error as e:
        raise InvalidRegularExpression(f"{pattern}: {e}") from e
    return "(?i)" + text if ignore_case else text
