import os
import textwrap

import pytest

from voxelmill.llm import license_scan

FOLDER = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.exists(f"{FOLDER}/Apache-2.0"), reason="no licence texts on this machine")
def test_whole_licenses_are_found(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}
    some = [(k, open(f"{FOLDER}/{f}", encoding="utf-8").read()) for k, f in enumerate(names)]
    some += [(100 + k, t.upper().replace(",", " ;")) for k, t in some] + [(200, some[0][1] + " and more")]
    got = {r[0]: r["license_id"] for r in license_scan.scan(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    want = dict(enumerate(names.values()))
    assert got == {**want, **{100 + k: x for k, x in want.items()}, 200: None}


def test_short_licenses_in_several_wrappings(spark):
    seen, some, want = set(), [], {}
    for name, text in license_scan.KNOWN:
        if len(text) < 300 or name in seen:
            continue
        seen.add(name)
        head = f"Copyright (c) 2021, {name} Authors\nAll rights reserved.\n\n"
        shapes = [head + text, *[head + "\n".join(textwrap.fill(p, w) for p in text.split("\n\n")) for w in (60, 76)]]
        shapes.append("\n".join(f" * {line}" for line in shapes[1].splitlines()))
        for shape in shapes:
            want[len(some)] = name
            some.append((len(some), shape))
    # a wrap that puts the word at the head of a line
    some.append((len(some), license_scan._ISC.replace("above copyright", "above\ncopyright")))
    want[len(some) - 1] = "ISC"
    got = {r[0]: r["license_id"] for r in license_scan.scan(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert got == want and {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "BSL-1.0", "0BSD", "MIT-0"} <= seen


def test_known_texts_from_a_table(spark):
    known = license_scan.known_digests(spark, spark.createDataFrame([("House-1.0", "You may read this. Nothing else.")], "license string, text string"))
    docs = spark.createDataFrame([(1, "YOU MAY READ THIS; nothing else"), (2, "You may read")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in license_scan.scan(docs, known).collect()} == {1: "House-1.0", 2: None}
