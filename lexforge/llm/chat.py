r"""Chat formatting of typed content parts, with a loss mask, in DataFrame expressions.

A conversation is rows of (conv_id, turn, role, content). Content is a string or
an array of typed parts; the visitor flattens the parts of a turn into one body,
where text stands escaped and each image, audio clip or document leaves an
ordered placeholder ``<|kind:k|>`` (k counts the turn's attachments from 0), a
reference row and its expanded token count.

Template of a turn: ``<|turn|>role``, newline, body, ``<|end|>``. A conversation
is its turns in order, nothing between. Control strings (``CONTROLS``) inside
texts get one more backslash after their first character; strings that already
have backslashes there get one more too, so removing one backslash restores every
text and no text can close a turn. In roles, backslash and newline are written
``\b`` and ``\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of this template and of common others, as first character and rest.
CONTROLS = (
    "<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<start_of_turn>", "<end_of_turn>",
)
KINDS = ("image", "audio", "document")
TURN, END = "<|turn|>", "<|end|>"
#: Rows that one task puts in order before a conversation's pieces meet.
CHUNK_TURNS = 64


def _quote(s: str) -> str:
    return "".join("\\" + c if c in r"\|[]()<>/{}*+?.^$" and c not in "<>/" else c for c in s)


_TAIL = "|".join(sorted({_quote(c[1:]) for c in CONTROLS} | {rf"\|(?:{'|'.join(KINDS)}):[0-9]+\|>"}))
_OPEN = r"([<\[])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_OPEN}(\\*)(?={_TAIL})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_OPEN}(\\*)\\(?={_TAIL})", "$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A text as an array of one typed part."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"),
            *[none.cast("long").alias(c) for c in ("width", "height", "millis", "pages")],
        )
    )


def expanded_tokens(part: Column) -> Column:
    """What an attachment will take in the sequence: an image 1 for each 28 x 28 tile, audio 25 a second, a document 512 a page; at least 1."""

    def ceil(value: Column, by: int) -> Column:
        return F.ceil(F.coalesce(value, F.lit(0)) / F.lit(by))

    tokens = (
        F.when(part["type"] == "image", ceil(part["width"], 28) * ceil(part["height"], 28))
        .when(part["type"] == "audio", ceil(part["millis"], 40))
        .otherwise(F.coalesce(part["pages"], F.lit(0)) * 512)
    )
    return F.greatest(tokens.cast("long"), F.lit(1).cast("long"))


def visit(parts: Column) -> tuple[Column, Column]:
    """The body of a turn and its attachments (index, kind, ref, tokens), in order."""

    # Neighbouring texts are escaped as one, so no control string forms across their seam.
    def is_file(p: Column) -> Column:
        return F.coalesce(p["type"], F.lit("text")).isin(*KINDS)

    parts = F.coalesce(parts, F.slice(text_part(F.lit("")), 1, 0))
    files = F.transform(
        F.filter(parts, is_file),
        lambda p, i: F.struct(i.alias("index"), p["type"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
    )
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("run"), F.lit(0).alias("k"))

    def step(a: Column, p: Column) -> Column:
        mark = F.concat(F.lit("<|"), p["type"], F.lit(":"), a["k"].cast("string"), F.lit("|>"))
        on_file = F.struct(F.concat(a["out"], escape(a["run"]), mark).alias("out"), F.lit("").alias("run"), (a["k"] + 1).alias("k"))
        on_text = F.struct(a["out"].alias("out"), F.concat(a["run"], F.coalesce(p["text"], F.lit(""))).alias("run"), a["k"].alias("k"))
        return F.when(is_file(p), on_file).otherwise(on_text)

    return F.aggregate(parts, start, step, lambda a: F.concat(a["out"], escape(a["run"]))), files


def format_conversations(rows: DataFrame, parts: Column, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, segment_lengths, loss_spans, attachments, n_expanded_tokens.

    Turns go in the order (turn, role, content), so equal turns have one order and
    repeated rows stay. Null text is empty, a null role is an empty role, a null
    conv_id is a conversation of its own and null turns come first. loss_spans are
    (turn index, start, length) in code points of that turn's segment;
    segment_lengths turn them into places of the whole string. Turns are first put
    together in chunks of neighbouring turn numbers, so of a conversation that
    holds a large share of all rows only finished chunks meet.
    """
    body, files = visit(parts)
    turn = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), body.alias("body"), files.alias("files"))
    head = F.concat(F.lit(TURN), escape_role(escape(F.col("role"))), F.lit("\n"))
    segment = F.struct(
        F.col("turn").alias("turn"),
        F.col("role").alias("role"),
        F.concat(head, "body", F.lit(END)).alias("segment"),
        F.when(F.col("role").isin(*loss_roles), F.struct(F.char_length(head).alias("start"), F.char_length("body").alias("length"))).alias("loss"),
        F.col("files").alias("files"),
    )
    chunks = turn.groupBy("conv_id", F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk")).agg(F.sort_array(F.collect_list(segment)).alias("s"))
    whole = chunks.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "s"))), lambda x: x["s"])).alias("s"))
    spans = F.transform("s", lambda x, i: F.struct(i.alias("turn"), x["loss"]["start"].alias("start"), x["loss"]["length"].alias("length")))
    attached = F.flatten(
        F.transform(
            "s",
            lambda x, i: F.transform(
                x["files"], lambda f: F.struct(i.alias("turn"), f["index"].alias("index"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))
            ),
        )
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("formatted"),
        F.size("s").cast("long").alias("n_turns"),
        F.transform("s", lambda x: F.char_length(x["segment"])).alias("segment_lengths"),
        F.filter(spans, lambda x: x["start"].isNotNull()).alias("loss_spans"),
        attached.alias("attachments"),
    ).withColumn("n_expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, f: n + f["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """The conversations read from ``formatted``: turns (role, body) and the text under the loss mask.

    The string is cut where a turn mark stands; no text can hold one. Bodies come
    back unescaped; placeholders stay as they are.
    """
    segments = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)

    def turn_of(x: Column) -> Column:
        role = unescape(unescape_role(F.substring_index(x, "\n", 1)))
        body = x.substr(F.instr(x, "\n") + 1, F.char_length(x) - F.instr(x, "\n") - len(END))
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    cut = formatted.withColumn("_segments", segments)
    under = F.transform(
        "loss_spans",
        lambda s: unescape(F.concat(F.lit(TURN), F.get("_segments", s["turn"])).substr(s["start"] + 1, s["length"])),
    )
    return cut.select("conv_id", "formatted", F.transform("_segments", turn_of).alias("turns"), F.array_join(under, "").alias("loss_text"))


def digests(back: DataFrame) -> DataFrame:
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
