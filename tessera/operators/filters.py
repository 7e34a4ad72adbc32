"""A small language of document predicates: names, + (or), * (and), - (not) and parentheses.

Names stand for Columns; the parser knows nothing else, so no text is evaluated.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:([A-Za-z_][A-Za-z0-9_]*)|([-+*()]))")


def parse(text: str, names: dict[str, Column]) -> Column:
    """The Column of an expression over names; TRUE and FALSE are known. - binds closest, then *, then +."""
    found, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at {at}: {text[at:]!r}")
        found.append(m[1] or m[2])
        at = m.end()
    known = {"TRUE": F.lit(True), "FALSE": F.lit(False)} | names
    found.append("")

    def take(what: str | None = None) -> str:
        if what is not None and found[0] != what:
            raise ValueError(f"expected {what!r}, found {found[0]!r}")
        return found.pop(0)

    def atom() -> Column:
        t = take()
        if t == "-":
            return ~atom()
        if t == "(":
            inner = either()
            take(")")
            return inner
        if t not in known:
            raise ValueError(f"unknown name {t!r}")
        return known[t]

    def both() -> Column:
        c = atom()
        while found[0] == "*":
            take()
            c = c & atom()
        return c

    def either() -> Column:
        c = both()
        while found[0] == "+":
            take()
            c = c | both()
        return c

    out = either()
    take("")
    return out


def has_element(markup: Column, tag: str) -> Column:
    """Does markup have this element anywhere?"""
    return F.coalesce(markup.rlike(f"(?i)<{re.escape(tag)}[\\s/>]"), F.lit(False))


def attribute(markup: Column, tag: str, name: str) -> Column:
    """An attribute of the first such element; empty if there is none."""
    return F.regexp_extract(markup, f"(?is)<{re.escape(tag)}\\b[^>]*?\\s{re.escape(name)}\\s*=\\s*\"([^\"]*)\"", 1)


def has_code(markup: Column, tag: str, name: str, code: str) -> Column:
    """Is `code` among the blank-separated words of an attribute of the first such element?"""
    return F.coalesce(F.array_contains(F.split(attribute(markup, tag, name), "\\s+"), code), F.lit(False))


def any_code(markup: Column, tag: str, name: str, code: str) -> Column:
    """Is `code` among the words of that attribute of any such element?"""
    return F.coalesce(markup.rlike(f"(?is)<{re.escape(tag)}\\b[^>]*?\\s{re.escape(name)}\\s*=\\s*\"([^\"]*\\s)?{re.escape(code)}(\\s[^\"]*)?\""), F.lit(False))


# The classification codes that have names of their own.
CODES = """
WRI SPO ACPROSE FICTION NONAC NEWS OTHERPUB UNPUB CONVRSN OTHERSP ALLAVA0 ALLAVA2 ALLTYP1 ALLTYP2 ALLTYP3 ALLTYP4 ALLTYP5
SCGDOM1 SCGDOM2 SCGDOM3 SCGDOM4 SDEAGE1 SDEAGE2 SDEAGE3 SDEAGE4 SDEAGE5 SDEAGE6 SDECLA0 SDECLA1 SDECLA2 SDECLA3 SDECLA4
SDESEX0 SDESEX1 SDESEX2 SPOLOG1 SPOLOG2 SPOREG0 SPOREG1 SPOREG2 SPOREG3 WRIAUD1 WRIAUD2 WRIAUD3 WRIAUD4 WRITAS1 WRITAS2 WRITAS3 WRITAS0
WRIAAG0 WRIAAG1 WRIAAG2 WRIAAG3 WRIAAG4 WRIAAG5 WRIAAG6 WRIAD1 WRIAD2 WRIAD3 WRIAD4 WRIAD5 WRIAD0 WRIASE0 WRIASE1 WRIASE2 WRIASE3
WRIATY1 WRIATY2 WRIATY3 WRIATY0 WRISTA0 WRISTA1 WRISTA2 WRISTA3 WRILEV1 WRILEV2 WRILEV3
WRIDOM1 WRIDOM2 WRIDOM3 WRIDOM4 WRIDOM5 WRIDOM6 WRIDOM7 WRIDOM8 WRIDOM9 WRIMED1 WRIMED2 WRIMED3 WRIMED4 WRIMED5
ALLTIM1 ALLTIM2 ALLTIM3 ALLTIM0 WRIPP0 WRIPP1 WRIPP2 WRIPP6 WRIPP3 WRIPP4 WRIPP5 WRISAM0 WRISAM1 WRISAM2 WRISAM3 WRISAM4 WRISAM5
""".split()
#: The codes that a text's own type attribute gives; the others stand in its class references.
TYPES = CODES[2:10]


def predefined(markup: Column) -> dict[str, Column]:
    """All names a filter expression may use: the codes, POETRY, TRUE and FALSE."""
    of_type = lambda c: F.coalesce((attribute(markup, "wtext", "type") == c) | (attribute(markup, "stext", "type") == c), F.lit(False))
    names = {c: of_type(c) if c in TYPES else has_code(markup, "catRef", "targets", c) for c in CODES}
    return names | {"POETRY": has_element(markup, "lg"), "TRUE": F.lit(True), "FALSE": F.lit(False)}
