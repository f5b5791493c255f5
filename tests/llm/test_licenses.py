import time

from pyspark.sql import functions as F

from parley.llm._shared import UPPER, ascii_lower
from parley.llm.licenses import scan_licenses


def test_phrases_places_and_labels(spark):
    texts = {
        1: "Under the MIT-License; mit license again. The MIT licensed one, under the mit license",
        2: "Apache License, Version 2.0 and CC BY-NC",
        3: "licensed under the GNU General Public License, version 3",
        4: "the mit and a license",
        5: "GNU General Public License",
        6: "MIT License",
    }
    found = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (found[1].n_base, found[1].first_word, found[1].last_word, found[1].base_labels) == (2, 0, 11, "mit")
    assert (found[2].n_base, found[2].base_labels, found[2].labels) == (2, "apache-2,cc-by-nc", "apache-2,cc-by-nc")
    assert (found[3].n_base, found[3].base_labels, found[3].labels, found[3].first_word) == (0, "", "gpl-3", None)
    assert (found[4].labels, found[4].score) == ("", 0.0)
    assert found[5].labels == ""
    assert (found[6].n_base, found[6].base_labels, found[6].labels) == (0, "", "mit")
    assert found[2].n_words == 9


def test_odd_rows(spark, odd, none):
    rows = scan_licenses(odd).collect()
    assert len(rows) == 10
    assert [r.base_labels for r in rows if r.doc_id is None] == ["mit"]
    assert all(r.n_words == 0 and r.labels == "" for r in rows if r.doc_id in (2, 3, 4))
    assert all(0 <= r.score <= 1 for r in rows)
    assert next(r.n_words for r in rows if r.doc_id == 5) == 8 * 3000
    assert scan_licenses(none).count() == 0


def test_a_very_long_text_of_notices(spark):
    notice = "Licensed under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of the work. "
    docs = spark.createDataFrame([(1, notice * 100), (2, notice * 1200)], "doc_id long, text string")
    scan_licenses(docs.where("doc_id = 1")).collect()  # plans and compiles
    began = time.time()
    found = scan_licenses(docs).where("doc_id = 2").first()
    assert found.n_words == 1200 * 21 and found.n_base == 1200 and (found.first_word, found.last_word) == (1, 1199 * 21 + 1)
    assert found.labels == "mit" and time.time() - began < 20


def test_lower_case_of_a_to_z_alone(spark):
    points = [(chr(i),) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame(points[:0x3000] + points[0xA000:0xB000] + points[0xF000:0x20000] + [("A\u03a3 \u0130B",)], "c string")
    assert rows.where(ascii_lower(F.col("c")) != F.translate("c", UPPER, UPPER.lower())).count() == 0
