import hashlib
import random

from pyspark.sql import functions as F

from lexforge.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted int"


def plain(rows):
    found = {}
    for conv, turn, role, text, _ in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    made = chat.format_conversations(df, chat.text_part(F.col("text")))
    return {r[0]: tuple(r)[1:5] for r in chat.digests(chat.read_back(made)).collect()}


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(3)
    bits = list(chat.CONTROLS) + ["<", "[", "\\", "\\\\", "\n", "|", "/s>", "INST]", "a", "é", "<|image:0|>", "turn|>", "$1", "𝄞"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 5)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "a\\nb\n<|end|>", "", None]), "".join(rng.choices(bits, k=rng.randint(0, 12))), 1))
    rows += [(None, 0, "assistant", None, 1), (99, None, "assistant", "x", 1), (99, 0, "assistant", "y", 1), (99, 0, "assistant", "y", 1)]
    rows += [(100, t, "assistant" if t % 2 else "user", "word " * 50 + str(t), 1) for t in range(500)]
    rng.shuffle(rows)
    assert run(spark, rows) == plain(rows)


def test_no_bare_control_in_bodies(spark):
    texts = ["".join(p) for p in zip(chat.CONTROLS, reversed(chat.CONTROLS))] + ["<\\/s>", "<\\\\/s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, back in df.select("t", chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t")))).collect():
        assert back == t and not any(c in e for c in chat.CONTROLS)


def test_parts_become_ordered_placeholders(spark):
    part = "struct<type:string,text:string,ref:string,width:long,height:long,millis:long,pages:long>"
    parts = [
        ("text", "see <", None, None, None, None, None),
        ("text", "/s>", None, None, None, None, None),
        ("image", None, "a.png", 280, 56, None, None),
        ("text", "<|image:0|>", None, None, None, None, None),
        ("audio", None, "b.wav", None, None, 1000, None),
        ("document", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", *[None] * 5)]), (2, 0, "user", None)], f"conv_id long, turn long, role string, parts array<{part}>")
    made = chat.format_conversations(df, F.col("parts"))
    got = {r.conv_id: r for r in made.collect()}
    assert got[1].formatted == "<|turn|>user\nsee <\\/s><|image:0|><\\|image:0|><|audio:1|><|document:2|><|end|><|turn|>assistant\nok<|end|>"
    assert [(a.turn, a["index"], a.kind, a.ref, a.tokens) for a in got[1].attachments] == [(0, 0, "image", "a.png", 20), (0, 1, "audio", "b.wav", 25), (0, 2, "document", None, 1)]
    assert got[1].n_expanded_tokens == 46 and got[2].attachments == [] and got[2].formatted == "<|turn|>user\n<|end|>"
    spans = got[1].loss_spans
    start = sum(got[1].segment_lengths[: spans[0].turn]) + spans[0].start
    assert got[1].formatted[start : start + spans[0].length] == "ok"


def test_empty_table(spark):
    assert run(spark, []) == {}
