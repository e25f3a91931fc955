import random

from corvane.streaming import answers

SCHEMA = "request string, part int, text string, last boolean, names map<string,string>"
NAMES = {"[NAME_1]": "Ada [EMAIL_1]", "[NAME_12]": "Bo", "[EMAIL_1]": "a@b.c", "[PHONE_1]": ""}


def parts_of(request, text, rng, most=9):
    cuts = [0]
    while cuts[-1] < len(text):
        cuts.append(min(len(text), cuts[-1] + rng.randrange(0, most)))
    pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])] or [""]
    return [(request, i, p, i == len(pieces) - 1, NAMES if i == 0 else None) for i, p in enumerate(pieces)]


def test_cut_and_replace():
    assert answers.cut_at("a [NAM") == 2 and answers.cut_at("a [NAME_1] b") == 12 and answers.cut_at("[" + "x" * 30) == 31 and answers.cut_at("") == 0
    assert answers.replaced("[NAME_1][NAME_12] [NAME_3]", NAMES) == "Ada [EMAIL_1]Bo [NAME_3]"


def test_any_split_gives_the_whole_answer(spark, tmp_path):
    rng = random.Random(4)
    bits = [*NAMES, "[", "]", "[NAME_", "[NAME_99]", "plain words ", "[see the list of things below]", "\n"]
    whole = {f"r{k}": "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for k in range(40)} | {"open": "ends in [NAME_1"}
    rows = [row for request, text in whole.items() for row in parts_of(request, text, rng)]
    # micro-batches that mix the requests and bring parts out of order; names come with the first batch, one part twice
    heads, rest = [r for r in rows if r[1] == 0], [r for r in rows if r[1]]
    rng.shuffle(rest)
    batches = [heads, rest[: len(rest) // 3], rest[len(rest) // 3 :] + heads[:3] + rest[:5] + [("r1", None, "x", False, None)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    checkpoint, got = str(tmp_path / "cp"), []
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        # the query starts anew for every file, so what is held back is read from its checkpoint
        run = answers.restored(stream).writeStream.foreachBatch(lambda b, n: got.extend(map(tuple, b.collect()))).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    assert len({g[:2] for g in got}) == len(got) == len(rows)
    assert {k: "".join(t for _, _, t in sorted(g for g in got if g[0] == k)) for k in whole} == {k: answers.replaced(t, NAMES) for k, t in whole.items()}


def test_batch_and_empty(spark):
    rows = parts_of("a", "Dear [NAME_12], call [PHONE_1]x", random.Random(1), 3)
    got = answers.restored(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert "".join(r.text for r in sorted(got, key=lambda r: r.part)) == "Dear Bo, call x"
    assert answers.restored(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_table_needs_no_state(spark):
    """Parts in any order, repeated, without a number, with a gap and after the last one, as a stream takes them in one batch; null requests too."""
    rows = [
        ("a", 1, "E_1] x", False, None), ("a", 0, "to [NAM", False, {"[NAME_1]": "Ann"}), ("a", 0, "to [NAM", False, None), ("a", 2, None, True, None), ("a", 3, "late", False, None),
        ("b", 0, "one [", False, None), ("b", 2, "gap", True, None), ("b", None, "none", False, {"[NAME_1]": "Bo"}), (None, 0, "[NAME_1]", True, {"[NAME_1]": "Cy"}),
    ]
    table = answers.restored(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert "StreamingPythonRunner" not in (plan := table._jdf.queryExecution().toString()) and "TransformWithState" not in plan
    assert sorted(map(tuple, table.collect()), key=str) == sorted([("a", 0, "to "), ("a", 1, "Ann x"), ("a", 2, ""), ("b", 0, "one "), (None, 0, "Cy")], key=str)
