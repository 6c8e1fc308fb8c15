"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line and paragraph of every whole text is compared with the notices and openings of well-known licences by
the cosine of sparse TF-IDF vectors over the templates' terms; those without any telling term are passed over, as
they can't reach the cosine. Every whole text is compared in the same way with the whole licence texts of the folder
``licence_texts``. Document frequencies of these terms are counted over all texts of the corpus. A text
that is mostly licence words, or a whole licence text, is a licence file and speaks for its directory; lines of
the licence text it is aren't headers of other licences. An SPDX line is a header of each licence that its
expression names, at cosine 1, of those without a template under the name as written. A document without a
header of its own inherits from the nearest ancestor directory that has one, found by joins on paths:
every directory is exploded into its ancestors, as many as the path is deep, and the deepest match is kept.

Defined cases: null and empty texts have no header and inherit; paths without a directory belong to the
root; a null path inherits nothing; of several matches in a document the highest cosine is reported and
all distinct licences are listed; ties go to the smaller name; repeated rows are scanned row by row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_row

#: Notices and opening lines by which licences are recognised.
TEMPLATES = {
    "AGPL-3.0": ("licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    "Apache-2.0": ("licensed under the apache license version 2.0", "apache license version 2.0 january 2004 http www.apache.org licenses", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0"),
    "BSD-2-Clause": ("licensed under the bsd 2-clause license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    "BSD-3-Clause": ("licensed under the bsd 3-clause license", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "CC-BY-4.0": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "CC-BY-NC-4.0": ("licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"),
    "CC-BY-SA-4.0": ("licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"),
    "CC0-1.0": ("licensed under cc0 1.0", "creative commons zero cc0 1.0 universal public domain dedication"),
    "GPL-2.0": ("this work is licensed under the gnu general public license version 2", "gnu general public license version 2 june 1991", "distributed under the terms of the gnu gpl v2"),
    "GPL-3.0": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3 29 june 2007", "distributed under the terms of the gnu gpl v3"),
    "ISC": ("licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "LGPL-3.0": ("licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3 29 june 2007"),
    "MIT": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0"),
    "Unlicense": ("this is free and unencumbered software released into the public domain", "released under the unlicense"),
}
_TERM = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]")


#: An SPDX expression: identifiers joined by operators, in any brackets.
_SPDX = re.compile(r"spdx-license-identifier[ \t]*:[ \t(]*([a-z0-9][a-z0-9.+-]*(?:[ \t()]*(?:[ \t()](?:and|or|with)[ \t(]|/)[ \t(]*[a-z0-9][a-z0-9.+-]*)*)", re.IGNORECASE)
_OPERATOR = re.compile(r"[ \t()]*(?:[ \t()](and|or|with)[ \t(]|/)[ \t(]*", re.IGNORECASE)
_NAMES = {name.lower(): name for name in TEMPLATES}


def spdx(line: str) -> list[str]:
    """The licences that the SPDX headers of a line name; exceptions are no licences."""
    out = []
    for m in _SPDX.finditer(line):
        first, *rest = _OPERATOR.split(m[1])
        ids = [first, *(x for how, x in zip(rest[::2], rest[1::2], strict=True) if (how or "").lower() != "with")]
        for x in (x.rstrip(".-") for x in ids):
            plain = re.sub(r"(-only|-or-later|\+)$", "", x.lower())
            if plain not in ("none", "noassertion"):
                out.append(_NAMES.get(plain, x))
    return out


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def bodies() -> dict[str, tuple[str, ...]]:
    """The whole licence texts; they are read on the driver only."""
    top = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")
    out = {}
    for f in sorted(os.listdir(top)):
        with open(os.path.join(top, f), encoding="utf-8") as x:
            out[f.removesuffix(".txt")] = (x.read(),)
    return out


def vocabulary(templates: dict[str, tuple[str, ...]]) -> frozenset[str]:
    return frozenset(t for texts in templates.values() for x in texts for t in terms(x))


class Matcher:
    def __init__(self, df: dict[str, int], n: int, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.idf = {t: 1 + math.log((n + 1) / (df.get(t, 0) + 1)) for t in vocabulary(templates)}
        # a term that no template has tells a line from a template as a rare one would
        self.other = 1 + math.log(n + 1)
        self.templates = [(name, self._vector(Counter(terms(x)))) for name, texts in sorted(templates.items()) for x in texts]
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        for i, (_, v) in enumerate(self.templates):
            for t, w in v.items():
                self.by_term.setdefault(t, []).append((i, w))

    def telling(self, least: float) -> frozenset[str]:
        """Terms of which any text at this cosine to a template holds one.

        All others are so common that their part of any template is shorter than ``least``, and what a text shares
        with a template of these alone gives no more than that.
        """
        common: set[str] = set()
        part = [0.0] * len(self.templates)
        for t in sorted(self.by_term, key=lambda t: (self.idf[t], t)):
            grown = {i: part[i] + w * w for i, w in self.by_term[t]}
            if all(x < least * least - 1e-9 for x in grown.values()):
                common.add(t)
                for i, x in grown.items():
                    part[i] = x
        return frozenset(self.by_term) - common

    def _vector(self, counts: Counter) -> dict[str, float]:
        v = {t: (1 + math.log(k)) * self.idf.get(t, self.other) for t, k in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def best(self, text: str) -> tuple[str, float] | None:
        """The template nearest to a text, by sparse products; ties go to the smaller name."""
        counts = Counter(terms(text))
        if not counts:
            return None
        score: dict[int, float] = {}
        for t, x in self._vector(counts).items():
            for i, w in self.by_term.get(t, ()):
                score[i] = score.get(i, 0.0) + x * w
        if not score:
            return None
        i = max(sorted(score), key=lambda k: round(score[k], 12))
        return self.templates[i][0], score[i]


def headers(text: str, matcher: Matcher, telling: frozenset[str], least: float, body: str = "") -> tuple[list[tuple[str, float, int]], int]:
    """``(licence, cosine, line)`` of the matching lines, best first, and the words in them.

    ``telling``: a line without any of these terms is at no template, and neither is a paragraph of such lines.
    ``body``: terms of the licence text that the whole text is; what stands in it is no header of its own.
    """
    low = text.lower()
    marked = "spdx" in low
    if not marked and telling.isdisjoint(_TERM.findall(low)):
        return [], 0
    found, words, k = [], 0, 0
    for blank, group in itertools.groupby(text.split("\n"), key=lambda x: not x.strip()):
        lines = list(group)
        held = [] if blank else [(k + j, x) for j, x in enumerate(lines) if not telling.isdisjoint(terms(x)) or marked and "spdx" in x.lower()]
        if body:
            held = [(j, x) for j, x in held if f" {' '.join(terms(x))} " not in body]
        k += len(lines)
        if not held:
            continue
        named = {j: spdx(x) for j, x in held if "spdx" in x.lower()}
        hits = [(*m, j) for j, x in held if not named.get(j) and (m := matcher.best(x)) and m[1] >= least]
        matched = {h[2] for h in hits} | {j for j, x in named.items() if x}
        size = sum(len(x.split()) for j, x in held if j in matched)
        rest = [x for j, x in enumerate(lines, k - len(lines)) if not named.get(j)]
        whole = matcher.best(" ".join(rest))
        if whole and whole[1] >= least and whole[1] > max((h[1] for h in hits), default=0.0):
            # lines that match another licence stay
            hits = [(*whole, held[0][0]), *(h for h in hits if h[0] != whole[0])]
            size = sum(len(x.split()) for x in lines)
        found += hits + [(name, 1.0, j) for j, x in named.items() for name in x]
        words += size
    return sorted(found, key=lambda x: (-x[1], x[0], x[2])), words


def ancestors(directory: Column) -> Column:
    """The directory, every directory above it, and the root, as an array of paths."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scanned_text(text: str, matcher: Matcher, telling: frozenset[str], whole: Matcher, joined: dict[str, str], least: float, file_share: float) -> tuple:
    """``own, cosine, licenses, is_file`` of one text.

    Of a text at this cosine to a licence text, ``file_share`` of the squared norm lies along it. A licence text whose
    title is that of a licence without a text here, such as a variant of one that has, goes by its title.
    """
    body = whole.best(text)
    if body and body[1] < max(least, math.sqrt(file_share)):
        body = None
    titled = None
    if body:
        top = list(itertools.islice((x for x in text.split("\n") if x.strip()), 2))
        titles = [m for x in (top[0], " ".join(top)) if (m := matcher.best(x)) and m[1] >= least]
        title = max(titles, key=lambda m: m[1], default=None)
        titled = title if title and title[0] not in joined else None
    found, words = headers(text, matcher, telling, least, joined[body[0]] if body else "")
    is_file = body is not None or bool(found) and words >= file_share * len(text.split())
    body = titled or body
    lead = body or (found[0][:2] if found else (None, None))
    return *lead, sorted({x[0] for x in found} | ({body[0]} if body else set())), is_file


def license_scan(docs: DataFrame, path: Column, least: float = 0.6, file_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, path, own, cosine, licenses, is_file, license, inherited_from``."""
    spark = docs.sparkSession
    texts = bodies()
    counted = vocabulary(TEMPLATES) | vocabulary(texts)
    d = docs.select(docs[id_col].alias("doc_id"), path.cast("string").alias("path"), docs[text_col].alias("text"))

    def frequencies(batches):
        for b in batches:
            df: Counter = Counter()
            n = 0
            for t in b.column("text").to_pylist():
                df.update(counted.intersection(_TERM.findall((t or "").lower())))
                n += 1
            df["\0"] = n
            yield pa.RecordBatch.from_arrays([pa.array(list(df)), pa.array(list(df.values()), pa.int64())], ["term", "n"])

    # as many rows as the templates and licence texts have terms
    df = {r.term: r.n for r in d.select("text").mapInArrow(frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast((df, texts))
    keyed = with_row(d)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        df, texts = sent.value
        n = df.get("\0", 0)
        matcher, whole = Matcher(df, n), Matcher(df, n, texts)
        telling = matcher.telling(least)
        joined = {name: f" {' '.join(terms(x))} " for name, (x,) in texts.items()}
        for b in batches:
            out = [scanned_text(t or "", matcher, telling, whole, joined, least, file_share) for t in b.column("text").to_pylist()]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("doc_id"), b.column("path"), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()), strict=True))], ["_row", "doc_id", "path", "own", "cosine", "licenses", "is_file"])

    scanned = cut(keyed.mapInArrow(run, f"_row long, doc_id {kind}, path string, own string, cosine double, licenses array<string>, is_file boolean"))
    place = F.regexp_replace("path", r"(^|/)[^/]*$", "")
    scanned = scanned.withColumn("dir", place)
    files = scanned.where("is_file and path is not null").groupBy("dir").agg(F.max_by("own", F.struct("cosine", "own")).alias("of_dir"))
    dirs = scanned.where("own is null and path is not null").select("dir").distinct()
    up = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("above"))
    near = up.join(files.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("of_dir", "above"), F.length("above")).alias("got"))
    out = scanned.join(near, "dir", "left")
    took = F.when(F.col("own").isNull(), F.col("got.of_dir"))
    return out.select("doc_id", "path", "own", "cosine", "licenses", "is_file", F.coalesce("own", took).alias("license"), F.when(F.col("own").isNull(), F.col("got.above")).alias("inherited_from"))
