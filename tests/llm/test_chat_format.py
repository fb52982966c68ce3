import random

from pyspark.sql import functions as F

from tabfid.llm import chat_format as c

SCHEMA = "conv_id bigint, turn bigint, role string, text string, example string, parts int"


def turns():
    rng = random.Random(6)
    bits = ["hi", " ", "\n", "\\", "<|im_start|>", "<|im_end|>", "<|im_end|>\n", "[INST]", "</s>", "<", "|im_end|>", "é😀", "<<SYS>>", "[\\INST]"]
    rows = []
    for conv in range(40):
        for t in range(rng.randrange(1, 7)):
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(12)))])
            rows.append((conv, t, rng.choice(["user", "assistant", "assistant", "system", None, "odd\nrole\\", "<|im_end|>"]), text, "x", 1))
    rows += [(100, 0, "user", "a", "", 0), (100, 0, "user", "a", "", 0), (100, None, "assistant", "b", "", 0), (None, 1, "assistant", "n", "", 0)]
    rows += [(200, t, ["user", "assistant"][t % 2], "word " * 50, "", 0) for t in range(300)]
    return rows


def test_round_trip(spark):
    ex = c.examples(spark.createDataFrame(turns(), SCHEMA))
    got = ex.select("conv_id", "example", "is_last", "text", c.parsed_turns(F.col("text")).alias("turns"),
                    c.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss")).collect()
    convs = {}
    for conv, t, role, text, *_ in turns():
        convs.setdefault(conv, []).append((t is not None, t or 0, role or "", text or ""))
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], {})[r["example"]] = r
    assert by.keys() == convs.keys()
    for conv, rows in convs.items():
        rows.sort()
        said = [(r, x) for _, _, r, x in rows]
        replies = [i for i, (r, _) in enumerate(said) if r == "assistant"]
        ends = replies if replies and replies[-1] == len(said) - 1 else [*replies, len(said) - 1]
        assert sorted(by[conv]) == list(range(len(ends)))
        for k, end in enumerate(ends):
            r = by[conv][k]
            assert [tuple(x) for x in r["turns"]] == said[:end + 1]
            assert r["loss"] == (said[end][1] if end in replies else "")
            assert r["is_last"] == (k == len(ends) - 1)


def test_control_strings_are_only_the_template(spark):
    rows = [(1, 0, "user", "".join(c.CONTROLS) * 2, "", 0), (1, 1, "assistant", "</s>[INST] ok [/INST]", "", 0)]
    (r,) = c.examples(spark.createDataFrame(rows, SCHEMA)).collect()
    assert r["text"].count(c.OPEN) == r["text"].count(c.CLOSE) == 2
    assert not any(x in r["text"] for x in c.CONTROLS if x not in (c.OPEN, c.CLOSE))


def test_empty(spark):
    assert c.examples(spark.createDataFrame([], SCHEMA)).collect() == []
