import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from lexforge.llm import align, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    return align.Tokenizers(A, B)


def spans(tokens):
    at, out = 0, []
    for i, body in tokens:
        out.append((i, at, at + len(body)))
        at += len(body)
    return out


def brute(rows, t):
    """Whole texts, all pairs of tokens held against each other."""
    linked, made = [], []
    for _, text in rows:
        made.append(([], [], [], []))
        linked.append(Counter())
        if not text:
            continue
        a = [(i, t.a_bytes[i]) for i in t.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, t.b_bytes[i]) for i in t.b.encode(text)]
        body = (" " + text).encode()
        if b"".join(x for _, x in a) != body or b"".join(x for _, x in b) != body:
            continue
        sa, sb = spans(a), spans(b)
        starts = sorted((s, e, i) for i, s, e in sb)
        k = 0
        for i, s, e in sa:
            while k < len(starts) and starts[k][1] <= s:
                k += 1
            m = k
            while m < len(starts) and starts[m][0] < e:
                linked[-1][i, starts[m][2]] += 1
                m += 1
        cuts = sorted({e for *_, e in sa} & {e for *_, e in sb})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, s, e in sa if low < e <= c) + "|" + ",".join(str(i) for i, s, e in sb if low < e <= c) if len(sa) < 300 else None)
            low = c
        if len(sa) >= 300:
            own = {c: k for k, c in enumerate(cuts)}
            sides = [[[] for _ in cuts], [[] for _ in cuts]]
            for side, tokens in zip(sides, (sa, sb)):
                k = 0
                for i, s, e in tokens:
                    side[k].append(str(i))
                    k += e in own
            groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides)]
        made[-1] = (sa, sb, groups, [])
    documents = Counter(p for x in linked for p in x)
    most = defaultdict(int)
    for (i, _), n in documents.items():
        most[i] = max(most[i], n)
    out = []
    for (doc_id, _), (sa, sb, groups, _), pairs in zip(rows, made, linked):
        best = sum(n for p, n in pairs.items() if documents[p] == most[p[0]])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(sa), len(sb), len(groups), sum(pairs.values()), best, sum(n * documents[p] for p, n in pairs.items()), digest))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


ODD = [
    "a  b", " a", "a ", "a▁b", "é é", "ﬁx", "a\n b", "a\n\nb \n c\n", " ", "  ", "\n", "\n\n", "a\x00b", " a   b", "x\t y", "don't we'll 's", "a\r\n b\r",
    "<|endoftext|> x </s><s>", "<0x41> <unk>", "日本語 テキスト。 1234 56", "🙂🙂 👩‍👩‍👧", "a" * 3000, "word " * 500, "1 2  3   4    5", "tab\t\t tab", "end \n", "z  y　 x", "....... !!!??? ;\r",
]


def test_parts_give_the_whole_texts_tokens(both):
    """The cut texts hold the same ids as whole ones, for odd texts, random ones and given documents."""
    assert both.can_cut
    rng = random.Random(11)
    alphabet = [" ", " ", "\n", "\t", "a", "b", "the", "'s", "1", "é", "▁", ",", ".", " ", "\r", "日", "<s>", "\x1c", "\u0085"]
    texts = [x for x in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text <> ''").fetchall()]
    for text in texts:
        a, b = both.encode(both.parts(text))
        assert [i for x in a for i in x] == both.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert [i for x in b for i in x] == both.b.encode(text), repr(text)


def test_odd_rows_match_brute_force(spark, both):
    rows = [(k, x) for k, x in enumerate(ODD)] + [(None, "a b"), (None, "a b"), (3, "a b"), (100, None), (101, "")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_a", "'x' AS row")
    assert got(align.align(docs, A, B)) == brute(rows, both)


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0


@pytest.mark.parametrize("hot", [1, 50, align.MOST_HOT])
def test_pairs_beyond_the_hot_ones_are_joined(spark, both, monkeypatch, hot):
    rng = random.Random(5)
    words = ["alpha", "beta,", "gamma.", "unmöglich", "x1y2", "don't", "Straße", "zzz"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for k in range(150)]
    assert got(align.align(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B, most_hot=hot)) == brute(rows, both)


def test_forgetting_changes_nothing(both, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(align, "BATCH_BYTES", 200)
    rows = [(k, f"word{k % 7} other{k % 11}\nlast{k % 3} {k}") for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array(range(100)), pa.array([r[1] for r in rows])], ["doc_id", "row", "text"])

    def run():
        table = pa.Table.from_batches(align._aligner(A, B)([batch]))
        docs = table.filter(pa.compute.is_valid(table["row"])).drop_columns(["pairs", "documents"]).to_pylist()
        counts = Counter()
        for p, n in zip(table["pairs"].drop_null().to_pylist(), table["documents"].drop_null().to_pylist()):
            for x, y in zip(p, n):
                counts[x] += y
        return docs, counts

    plain = run()
    monkeypatch.setattr(align, "MOST_REMEMBERED", 20)
    monkeypatch.setattr(align, "MOST_COUNTED", 20)
    assert run() == plain


def test_query_matches_brute_force(spark, both):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert got(queries.op11_align(spark, "/root/testdata/sf0.001")) == brute(rows, both)
