"""Each licence template is found wrapped as well as unwrapped, and across full stops and blank lines."""

import textwrap

from codeweft.llm.licenses import TEMPLATES, license_blocks, scan_licenses


def test_every_template_wrapped_and_unwrapped(spark):
    lines = lambda t, n: textwrap.wrap(t, n, break_long_words=False)
    filler = "Copyright 2020 somebody of somewhere. "
    shapes = {
        "plain": lambda t: f"{filler}{t}. More text follows here.",
        "wrapped": lambda t: f"{filler}\n\n" + "\n".join(lines(t, 24)) + "\nMore text follows here.",
        "header": lambda t: "\r\n".join(f" * {line}" for line in lines(f"{filler}{t}. More text follows.", 30)),
        "words": lambda t: "\n".join(t.split()),
        "apart": lambda t: f"{filler}\n\n" + "\n\n".join(lines(t, 40)),
        "far": lambda t: "word " * 5000 + "\n".join(lines(t, 20)) + " word" * 5000,
    }
    cases = [(n, i, shape(t)) for n, shape in shapes.items() for i, (_, t) in enumerate(TEMPLATES)]
    rows = spark.createDataFrame([(k, text) for k, (_, _, text) in enumerate(cases)], "doc_id long, text string")
    found = {(r["doc_id"], r["template"]) for r in license_blocks(rows).collect()}
    assert [(n, TEMPLATES[i]) for k, (n, i, _) in enumerate(cases) if (k, i) not in found] == []
    whole = {r["doc_id"]: r for r in scan_licenses(rows).collect()}
    assert len(whole) == len(cases) and all(TEMPLATES[i][0] in whole[k]["labels"].split(",") and whole[k]["score"] == 1.0 for k, (_, i, _) in enumerate(cases))


def test_scattered_words_are_no_notice(spark):
    text = "all of it. " + "word " * 10 + "rights are. " + "other " * 10 + "reserved. " + "Licensed to ill. under the bridge. cc me. by nc 9. 4 or 0"
    spread = "this. " + "x " * 90 + ". work is licensed. " + "y " * 90 + ". under a creative commons. " + "z " * 90 + ". attribution 4 0 international license"
    found = scan_licenses(spark.createDataFrame([(1, text), (2, spread), (3, "\x01All\x01rights\nreserved"), (4, "\n \n"), (5, None), (6, "mit dem " + "der " * 40 + "und\nLicensed under the Apache License, Version 2.0.")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in found} == {1: "", 2: "", 3: "proprietary", 4: "", 5: "", 6: "apache"}
