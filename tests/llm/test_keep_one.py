from mediajobs.llm import jaccard


def text(name, n=30):
    return " ".join(f"{name}{i}" for i in range(n))


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    rows = [
        (1, text("a"), "a"), (1, text("b"), "b"),  # one id, unlike texts: nothing is near either
        (2, text("c"), "c"), (3, text("c") + " more", "c"), (3, text("d"), "d"), (3, text("d"), "d"),
        (None, text("c"), "c"), (None, text("e"), "e"), (None, text("e"), "e"), (None, text("e") + " more", "e"), (None, text("f"), "f"),
        (7, None, "none"), (7, "", "none"), (None, " \n", "none"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(3)
    got = [(r.extra, r.doc_id) for r in jaccard.keep_one(docs).collect()]
    want = [("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", None), ("f", None), ("none", 7), ("none", 7), ("none", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
