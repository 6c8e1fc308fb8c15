"""Field paths of a record as Columns over ``leader``, ``control`` and ``data``.

A field is given as five characters, tag and both indicators: ``?`` is any character, a blank is a
blank indicator, and brackets list alternatives, as in ``"246?[ 34]"``. Subfields are always arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _slots(path: str) -> list[str | None]:
    """Of each of the five characters what it may be; None is anything."""
    parts = re.findall(r"\[[^\]]*\]|.", path)
    if len(parts) != 5:
        raise ValueError(f"not a field path: {path!r}")
    return [None if p == "?" else p.strip("[]") if p.startswith("[") else p for p in parts]


def is_field(path: str) -> Callable[[Column], Column]:
    slots = _slots(path)

    def test(f: Column) -> Column:
        out = F.lit(True)
        tag = slots[:3]
        if all(t is not None and len(t) == 1 for t in tag):
            out = f["tag"] == "".join(tag)
        else:
            for i, t in enumerate(tag):
                if t is not None:
                    out = out & F.substring(f["tag"], i + 1, 1).isin(*t)
        for name, t in (("ind1", slots[3]), ("ind2", slots[4])):
            if t is not None:
                out = out & F.coalesce(f[name], F.lit(" ")).isin(*t)
        return out

    return test


def fields(*paths: str, where: Callable[[Column], Column] | None = None, of: Column | str = "data") -> Column:
    """The data fields of any of the paths, in the order of the record, or those among the fields ``of``."""
    tests = [is_field(p) for p in paths]

    def keep(f: Column) -> Column:
        out = tests[0](f)
        for t in tests[1:]:
            out = out | t(f)
        return out & where(f) if where else out

    return F.filter(of, keep)


def sub(field: Column, codes: str) -> Column:
    """All values of the subfields, in their order."""
    return F.transform(F.filter(field["sub"], lambda s: s["code"].isin(*codes)), lambda s: s["value"])


def sub1(field: Column, code: str) -> Column:
    """The first value of a subfield; null without one."""
    return F.try_element_at(sub(field, code), F.lit(1))


def has(field: Column, code: str) -> Column:
    return F.exists(field["sub"], lambda s: s["code"] == code)


def values(path: str, codes: str) -> Column:
    """All values of the subfields of all fields of a path."""
    return F.flatten(F.transform(fields(path), lambda f: sub(f, codes)))


def value(path: str, code: str) -> Column:
    return F.try_element_at(values(path, code), F.lit(1))


def control(tag: str) -> Column:
    """The first control field of a tag."""
    return F.try_element_at(F.filter("control", lambda c: c["tag"] == tag), F.lit(1))["value"]


def controls(tag: str) -> Column:
    return F.transform(F.filter("control", lambda c: c["tag"] == tag), lambda c: c["value"])
