from tessella.llm import chat, queries
from tests.llm.conftest import larger, same_as_sql

TURNS = "conv_id long, turn long, role string, text string, n long, k string"


def plain(rows):
    """{conv_id: (n_turns, n_copies, text)} of maximal conversations, by comparing all."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    convs = {c: [m[1:] for m in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, v in convs.items():
        same = [d for d, w in convs.items() if w == v]
        longer = any(len(w) > len(v) and w[: len(v)] == v for w in convs.values())
        first = min((d for d in same if d is not None), default=None)
        if c == first and not longer:
            out[c] = (len(v), len(same), "\n".join(f"<|im_start|>{r}\n{x}<|im_end|>" for r, x in v))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    return {r.conv_id: tuple(r)[1:] for r in chat.format_chats(df).collect()}


def test_query_equals_sql(spark, sf):
    same_as_sql(spark, larger(sf), "op10_chat")


def test_query_equals_brute_force(spark, sf):
    sf = larger(sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in queries.op10_chat(spark, sf).collect()} == plain(rows)


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "why?"), ("assistant", "because")]
    rows = [(c, t, *talk[t]) for c, n in ((10, 1), (11, 2), (12, 3), (13, 4), (14, 4), (9, 2)) for t in range(n)]
    rows += [(20, 0, "user", "hi"), (20, 1, "assistant", "other")]  # branches off
    rows += [(30 + k, 0, "user", "hi") for k in range(25)]  # a first turn that many share
    rows += [(60, 5, "user", "hi"), (60, 9, "assistant", "hello")]  # turn numbers only order
    got = run(spark, rows)
    assert got == plain(rows) and set(got) == {13, 20} and got[13][:2] == (4, 2)


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None), (2, 0, "", ""), (None, 0, "user", "a"), (None, 1, "user", "b"), (3, 0, "user", "a"), (4, None, "user", "z"), (4, 0, "user", "a"),
        (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "user", "w" * 300_000), (7, 0, "us", "er\nx"), (8, 0, "user", "\nx"),
    ]
    rows += [(9, 0, "user", x) for x in ("b", "a", "\u00e9", "B", "")]  # ties go by text
    rows += [(10, 0, "user", x) for x in ("", "B", "a")]
    got = run(spark, rows)
    assert got == plain(rows) and 10 not in got and got[9][2].index("a<|im_end|>") < got[9][2].index("b<|im_end|>")
    many = [(1, t, "user", f"turn {t}") for t in range(3000)] + [(2, t, "user", f"turn {t}") for t in range(2999)]
    assert set(run(spark, many)) == {1}
    assert run(spark, []) == {}


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op10_chat(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
