"""License scans of whole texts, wrapped headers and bare names."""

import math
import random
from collections import Counter

from tessera.llm import license

PROSE = [f"Ordinary words about item number {i} go on here, and on, with no end in sight." for i in range(12)]
GPL3 = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."


def test_whole_texts(spark):
    full = license.full_texts()
    rows = [(f"{n}/7", f"Copyright 2020 A. Person\n\n{t}") for n, t in full.items()] + [(f"{n}/x/8", "code") for n in full]
    rows += [("w/9", "\n".join(["import a", GPL3, "x = 1"])), ("w/10", f"{GPL3.replace('version 3', 'version 2')}\n\n" + "\n".join(PROSE)), ("n/11", "Title\nCC BY-SA 4.0\nwords"), ("n/12", "# GPL-3.0-or-later\n" + "\n".join(PROSE)), ("n/13", "// SPDX-License-Identifier: MIT\nint x;\n" + "\n".join(PROSE)), ("n/14", "\n".join(PROSE)), ("n/15", "\n".join([*PROSE, "Released under the MIT License.", *PROSE])), ("n/16", "SPDX-License-Identifier: Zlib\nint y;\n" + "\n".join(PROSE)), ("n/17", "apache 2 and the bsd 4 of old, cc by hand")]
    got = {r.path: r for r in license.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {n: (got[f"{n}/7"].own_license, got[f"{n}/7"].is_license_file, got[f"{n}/x/8"].license, got[f"{n}/x/8"].from_directory) for n in full} == {n: (n, True, n, n) for n in full}
    assert {p: got[p].own_license for p in ("w/9", "w/10", "n/11", "n/12", "n/13", "n/14", "n/15", "n/16", "n/17")} == {"w/9": "GPL-3.0", "w/10": "GPL-2.0", "n/11": "CC-BY-SA-4.0", "n/12": "GPL-3.0", "n/13": "MIT", "n/14": None, "n/15": "MIT", "n/16": None, "n/17": None}
    assert not got["n/15"].is_license_file and not got["w/10"].is_license_file


def test_relatives(spark):
    """A license without a template of its own text is not named after its relative."""
    full = license.full_texts()
    affero = full["GPL-3.0"].replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")
    sa = full["CC-BY-SA-4.0"]
    both = sa.replace("Attribution-ShareAlike", "Attribution-NonCommercial-ShareAlike")
    rows = [("a/LICENSE", affero), ("a/x", "code"), ("b/y", both), ("b/x", "code"), ("c/COPYING", sa.replace("ShareAlike", "NoDerivatives")), ("c/x", "code"), ("d/z", sa.replace("ShareAlike", "NonCommercial")), ("e/z", sa), ("f/z", full["GPL-3.0"])]
    got = {r.path: (r.own_license, r.is_license_file, r.license) for r in license.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/LICENSE"] == ("AGPL-3.0", True, "AGPL-3.0") and got["a/x"] == (None, False, "AGPL-3.0")
    assert all(got[p] == (None, False, None) for p in ("b/y", "b/x", "c/COPYING", "c/x"))
    assert got["d/z"][0] == "CC-BY-NC-4.0" and got["e/z"] == ("CC-BY-SA-4.0", True, "CC-BY-SA-4.0") and got["f/z"] == ("GPL-3.0", True, "GPL-3.0")


def test_common_words_weigh_less(spark):
    """Terms that all evidence has weigh less than those of one file, whatever the templates say."""
    rows = [(f"a/{i}", f"we ask for permission of the owner {i}") for i in range(40)]
    weights, usual = license._frequencies(spark.createDataFrame(rows, "path string, text string"))
    assert weights[license.bucket("we ask")] < weights[license.bucket("owner 7")] < usual


def test_tree(spark):
    """A tree of files against plain loops over lines, templates and parents."""
    rng = random.Random(8)
    notices = ["Released under the MIT License.", "SPDX-License-Identifier: GPL-3.0-or-later", "licensed under cc by nc 4.0", "copyright of nobody in particular", "Licensed under the Apache License, Version 2.0"]
    full, rows = license.full_texts(), []
    for i in range(150):
        path = "/".join([*(rng.choice("abc") for _ in range(rng.randint(0, 4))), f"f{i}"])
        lines = [" ".join(rng.choices("ein zwei drei vier license x".split(), k=rng.randint(0, 9))) for _ in range(rng.randint(0, 8))]
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), rng.choice(notices))
        rows.append((path, "\n".join(lines)))
        if rng.random() < 0.06:
            rows.append((path[: path.rfind("/") + 1] + f"COPYING{i}", rng.choice(list(full.values()))))
    marked = [t for _, t in rows if license.marked(t)]
    seen = Counter(license.bucket(t) for text in marked for t in set(license.terms(text)))
    idf = lambda k: math.log((1 + len(marked)) / (1 + k)) + 1
    vector = lambda text: {t: (1 + math.log(n)) * idf(seen.get(license.bucket(t), 0)) for t, n in Counter(license.terms(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(n, vector(t)) for n in license.TEMPLATES for t in (*license.TEMPLATES[n], *([full[n]] if n in full else []))]

    def best(text):
        v = vector(text)
        return max(((sum(x * w.get(t, 0) for t, x in v.items()) / (norm(v) * norm(w)), n) for n, w in known), key=lambda f: f[0]) if v else (0.0, None)

    own, whole = {}, {}
    for path, text in rows:
        parts = license.evidence(text)
        every = best(text) if parts else (0.0, None)
        found = every if every[0] >= 0.5 else max([every, *map(best, parts)], key=lambda f: f[0])
        own[path] = found[1] if found[0] >= 0.5 else None
        whole[path] = every[0] >= 0.5 or own[path] is not None and path.rsplit("/", 1)[-1].startswith("COPYING")
    want = {}
    for path in own:
        at, given = path.rsplit("/", 1)[0] if "/" in path else "", None
        want[path] = own[path]
        while own[path] is None and given is None:
            given = min((p for p in own if whole[p] and (p.rsplit("/", 1)[0] if "/" in p else "") == at), default=None)
            if given or not at:
                break
            at = at.rsplit("/", 1)[0] if "/" in at else ""
        if own[path] is None and given:
            want[path] = own[given]
    got = {r.path: r.license for r in license.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want and sum(own[p] is None and want[p] is not None for p in want) > 10
