"""Operator 3: license scans by TF-IDF cosine and nearest-ancestor inheritance.

Evidence is compared to templates (short notices, standard headers, names, and the full texts in
licenses/) by the cosine of sparse TF-IDF vectors over word pairs. A file with a license mark
anywhere is compared by every range of adjacent lines around a marked line (up to REACH lines on
each side), by the whole block of lines that a marked line stands in, and by its whole text; the
best cosine counts. A license file is one whose whole text reaches the threshold, or that is
named LICENSE or COPYING and has any evidence that does. Document frequencies of all terms are
counted over all files with a mark, hashed into BUCKETS counters. A file with its own license
keeps it; any other inherits that of the nearest ancestor directory with a license file, by
equi-joins of (directory, ancestor) paths.

Relatives differ in few words: a whole text that has words which tell the licenses of its family
apart, but not those of the one it is nearest to, gets none.

Defined results: null text counts as empty and can only inherit; a null path has no ancestors;
ties between templates go to the first by name, ties between license files of one directory to
the least path; repeated rows each give a row; texts of any length are compared whole, a batch is
worked on in slices bounded by bytes; empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, lookup, slices

# Notices, standard headers and names of public licenses, each a template of its own.
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_UNDER = "licensed under the gnu {} version {}"
TEMPLATES = {
    "AGPL-3.0": [_UNDER.format("affero general public license", 3), _GNU.format("affero general public license", 3), "agpl 3.0 or later", "agpl 3.0 only", "agplv3", "agpl v3"],
    "Apache-2.0": [
        "licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license", "apache 2.0", "apache license 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    ],
    "BSD-3-Clause": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd license", "bsd 3 clause", "bsd 3 clause license", "license bsd"],
    "CC-BY-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "cc by 4.0"],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "cc by nc 4.0"],
    "CC-BY-SA-4.0": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "cc by sa 4.0"],
    "CC0-1.0": ["to the extent possible under law the author has waived all copyright and related rights", "cc0 1.0 universal public domain dedication", "cc0 1.0", "cc0 1.0 universal", "license cc0"],
    "GPL-2.0": [_UNDER.format("general public license", 2), _GNU.format("general public license", 2), "gpl 2.0 or later", "gpl 2.0 only", "gplv2", "gpl v2"],
    "GPL-3.0": [_UNDER.format("general public license", 3), _GNU.format("general public license", 3), "gpl 3.0 or later", "gpl 3.0 only", "gplv3", "gpl v3"],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "isc", "license isc", "isc license"],
    "LGPL-3.0": [_UNDER.format("lesser general public license", 3), _GNU.format("lesser general public license", 3), "lgpl 3.0 or later", "lgpl 3.0 only", "lgplv3", "lgpl v3"],
    "MIT": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "license mit", "mit license"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file", "mpl 2.0", "mozilla public license version 2.0"],
}
#: Lines on each side of a marked line that a range takes at most.
REACH = 3
BUCKETS = 1 << 18
#: Code points of evidence whose scores a task keeps.
KEPT_BYTES = 16 << 20
_MARK = re.compile(r"licen[sc]e|copyright|permission|redistribut|public domain|spdx|(?<![a-z0-9])(?:(?:[al]?gpl|mpl|apache|bsd)[- ]?v?[0-9]|gnu [al]?gpl|cc0|cc[- ]by(?![a-z0-9]))", re.I)
#: Of every mark, a part in lower case: a text without any of them has no mark.
_PARTS = ("licen", "copyright", "permission", "redistribut", "public domain", "spdx", "gpl", "mpl", "apache", "bsd", "cc0", "cc-by", "cc by")
_SPDX = re.compile(r"spdx-license-identifier:\s*(.+)", re.I)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> list[str]:
    """Word pairs, lower-cased; of a single word, the word."""
    words = _WORD.findall(text.lower())
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or words


def marked(text: str | None) -> bool:
    low = (text or "").lower()
    return any(p in low for p in _PARTS) and _MARK.search(text) is not None


def evidence(text: str | None) -> list[str]:
    """Parts of the text to compare, without the whole of it: around each line with a mark all
    ranges of adjacent lines, the block of lines it stands in, and what a tag names."""
    if not marked(text):
        return []
    lines, parts = text.split("\n"), {}
    full = [bool(_WORD.search(x.lower())) for x in lines]
    end = 0
    for i, line in enumerate(lines):
        if not full[i]:
            continue
        if i >= end:
            start, end = i, next((k for k in range(i, len(lines)) if not full[k]), len(lines))
        if _MARK.search(line):
            if tag := _SPDX.search(line):
                parts[tag[1].strip()] = None
            for a in range(i, max(start, i - REACH) - 1, -1):
                for b in range(i + 1, min(end, i + REACH + 1) + 1):
                    parts["\n".join(lines[a:b]).strip()] = None
            parts["\n".join(lines[start:end]).strip()] = None
    return list(parts)


#: Licenses without a text in licenses/: their nearest relative, and what its names turn into.
RELATIVES = {
    "AGPL-3.0": ("GPL-3.0", r"(?i)\b(GNU)(\s+)(?=General Public License)", r"\1 Affero\2"),
    "CC-BY-4.0": ("CC-BY-SA-4.0", r"(?i)-?Share-?Alike", ""),
    "CC-BY-NC-4.0": ("CC-BY-SA-4.0", r"(?i)Share-?Alike", "NonCommercial"),
}
#: What tells the licenses of the CC-BY family apart; a text has all words of its license and no other.
QUALIFIERS = {"CC-BY-4.0": set(), "CC-BY-NC-4.0": {"noncommercial"}, "CC-BY-SA-4.0": {"sharealike"}}
_QUALIFIER = re.compile(r"non-?commercial|share-?alike|no-?deriv", re.I)


def full_texts() -> dict[str, str]:
    """The full texts of licenses, by name; those of RELATIVES are the relative's text under their
    own names, which is nearer to their true text than the relative is."""
    folder = resources.files("tessera.llm") / "licenses"
    found = {f.name.removesuffix(".txt"): f.read_text() for f in sorted(folder.iterdir(), key=lambda f: f.name)}
    return found | {n: re.sub(pattern, by, found[of]) for n, (of, pattern, by) in RELATIVES.items()}


def contradicted(name: str | None, text: str, full: dict[str, str]) -> bool:
    """Whether a text of a license's length, at least half of it, has words that its name rules
    out; short names and notices abbreviate them."""
    return name in QUALIFIERS and 2 * len(text) >= len(full[name]) and {q.lower().replace("-", "") for q in _QUALIFIER.findall(text)} != QUALIFIERS[name]


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


class Matcher:
    """Cosine of a text's term vector to each template's. weights: inverse document frequency of
    terms, or of their buckets."""

    def __init__(self, weights: dict, usual: float, full: dict[str, str] | None = None):
        self.weights, self.usual = weights, usual
        texts = [(n, t) for n in TEMPLATES for t in (*TEMPLATES[n], *([full[n]] if n in (full or {}) else []))]
        self.names, self.size, self.index = [n for n, _ in texts], [], {}
        for i, (_, text) in enumerate(texts):
            v = self._vector(text)
            self.size.append(math.sqrt(sum(x * x for x in v.values())))
            for t, x in v.items():
                self.index.setdefault(t, []).append((i, x))

    def _vector(self, text: str) -> dict[str, float]:
        weigh = lambda t: self.weights.get(t, self.weights.get(bucket(t), self.usual))
        return {t: (1 + math.log(n)) * weigh(t) for t, n in Counter(terms(text)).items()}

    def best(self, text: str) -> tuple[float, str | None]:
        v = self._vector(text)
        norm = math.sqrt(sum(x * x for x in v.values()))
        dots: dict[int, float] = {}
        for t, x in v.items():
            for i, y in self.index.get(t, ()):
                dots[i] = dots.get(i, 0.0) + x * y
        found = (0.0, None)
        for i in sorted(dots):
            found = max(found, (dots[i] / (norm * self.size[i]), self.names[i]), key=lambda f: f[0])
        return found


def _frequencies(files: DataFrame) -> tuple[dict[int, float], float]:
    """Inverse document frequencies of the buckets of terms, over all files with a mark."""

    def count(batches):
        for b in (x for batch in batches for x in slices(batch, "text")):
            sums: Counter[int] = Counter()
            for text in b.column("text").to_pylist():
                if marked(text):
                    sums.update({-1, *map(bucket, set(terms(text)))})
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.int64())], ["term", "n"])

    n = dict(files.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False, name=None))
    total = n.pop(-1, 0)
    idf = lambda k: math.log((1 + total) / (1 + k)) + 1
    return {t: idf(k) for t, k in n.items()}, idf(0)


def own_licenses(files: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(path, own_license, own_score, is_license_file) for each of files(path, text)."""
    weights, usual = _frequencies(files)
    full = full_texts()

    def run(batches):
        matcher, seen, held = Matcher(weights, usual, full), {}, 0
        for b in (x for batch in batches for x in slices(batch, "text")):
            names, scores, whole = [], [], []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                best: tuple[float, str | None] = (0.0, None)
                parts = evidence(text)
                for part in parts:
                    score = seen.get(part)
                    if score is None:
                        score = matcher.best(part)
                        held += len(part) + 200
                        if held > KEPT_BYTES:
                            seen, held = {}, len(part) + 200
                        seen[part] = score
                    best = max(best, score, key=lambda f: f[0])
                stem = (path or "").rsplit("/", 1)[-1].upper()
                named = stem.startswith(("LICENSE", "LICENCE", "COPYING"))
                every = matcher.best(text) if text and (parts or named) else (0.0, None)
                # a text that is a license as a whole quotes others only in passing
                best = every if every[0] >= threshold else max(best, every, key=lambda f: f[0])
                if every[0] >= threshold and contradicted(every[1], text, full):
                    best = every = (best[0], None)
                ok = best[0] >= threshold and best[1] is not None
                names.append(best[1] if ok else None)
                scores.append(best[0])
                whole.append(ok and (every[0] >= threshold or named))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(whole, pa.bool_())], ["path", "own_license", "own_score", "is_license_file"])

    return files.select("path", "text").mapInArrow(run, "path string, own_license string, own_score double, is_license_file boolean")


def directory(path: Column) -> Column:
    """Of a path; empty for a file at the root."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def inherit(found: DataFrame) -> DataFrame:
    """Add license, score, from_directory (null for an own license) to own_licenses' rows."""
    found = found.withColumn("directory", directory(F.col("path")))
    at = found.filter("is_license_file").groupBy("directory").agg(F.min(F.struct("path", "own_license")).alias("least")).select(F.col("directory").alias("ancestor"), F.col("least.own_license").alias("given"))
    parts = F.split("directory", "/")
    ways = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    # distinct directories only, so a directory with very many files is one row here
    given = found.filter("directory is not null").select("directory").distinct().withColumn("ancestor", F.explode(ways)).join(at, "ancestor").groupBy("directory").agg(F.max_by(F.struct("ancestor", "given"), F.length("ancestor")).alias("near"))
    joined = found.join(lookup(cut(given)), "directory", "left")
    return joined.select("path", "own_license", "own_score", "is_license_file", F.coalesce("own_license", "near.given").alias("license"), F.when(F.col("own_license").isNull(), F.col("near.ancestor")).alias("from_directory"))


def scan_licenses(files: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(path, own_license, own_score, is_license_file, license, from_directory), one row for
    each of files(path, text)."""
    return inherit(cut(own_licenses(files, threshold)))
