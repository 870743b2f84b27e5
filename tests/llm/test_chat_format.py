import random

from pyspark.sql import functions as F

from loomline.llm import chat_format as C

LOG = "conv long, seq long, kind string, message long, role string, text string, other string"


def plain_fold(events):
    """{conv: {message: (role, text)}} by running through the events one after the other; equal seq aren't given here."""
    state = {}
    for conv, seq, kind, m, role, text in sorted(events, key=lambda e: e[1]):
        if m is None:
            continue
        messages = state.setdefault(conv, {})
        if kind == "open":
            messages[m] = (role or "", messages[m][1] if m in messages else "")
        elif kind == "delta":
            was = messages.get(m, ("", ""))
            messages[m] = (was[0], was[1] + (text or ""))
        elif kind == "edit":
            messages[m] = (messages.get(m, ("", ""))[0], text or "")
        elif kind == "regenerate":
            for later in [k for k in messages if k > m]:
                del messages[later]
            if m in messages:
                messages[m] = (messages[m][0], "")
    return state


def random_log(seed, n=60):
    r = random.Random(seed)
    events = []
    for conv in (1, 2, None):
        opened = set()
        for seq in r.sample(range(-50, 400), n):
            events.append([conv, seq, None, None, None, None])
        for e in sorted((e for e in events if e[0] is conv or e[0] == conv), key=lambda e: e[1]):
            m = r.choice([1, 2, 3, 4])
            kind = r.choices(["open", "delta", "edit", "regenerate", "note"], [1, 5, 1, 0.5, 0.2])[0]
            kind = "open" if m not in opened else kind
            opened = {x for x in opened if x <= m} if kind == "regenerate" else opened | {m}
            e[2:] = [kind, m, r.choice(["user", "assistant"]) if kind == "open" else None, r.choice(["a", "bc", "<|end|>", None, "\\"]) if kind != "open" else None]
    return events


def test_folding_equals_running_through_the_events(spark):
    for seed, span in ((1, 7), (2, 4096), (3, 1), (4, 50)):
        events = random_log(seed)
        log = spark.createDataFrame([(*e, "x") for e in events], LOG)
        got = {}
        for r in C.folded(log, span).collect():
            got.setdefault(r["conv"], {})[r["message"]] = (r["role"], r["text"])
        assert got == {k: v for k, v in plain_fold(events).items() if v}


def test_escapes_can_be_undone(spark):
    t = C.Template()
    bits = ["<", "[", "\\", "|turn|>", "s>", "/s>", "INST]", "<|end|>", "</s>", "[INST]", "a", "é", "\n", "<|text|>"]
    r = random.Random(5)
    texts = ["".join(r.choices(bits, k=r.randrange(9))) for _ in range(600)]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.escaped(F.col("x")).alias("e")).select("*", t.unescaped(F.col("e")).alias("back")).collect()
    for x, e, back in rows:
        assert back == x
        assert not any(c in e for c in (t.opens, t.between, t.closes, *t.controls))


def test_turns_and_loss_are_read_back(spark):
    odd = ["</s>[INST] ok [/INST]", "", "<", "end <|end|>\\", "\U0001f600 é <|tex", "x" * 300_000 + "\n" * 50]
    rows = [(c, i, ["user", "assistant", "system", "a\n<|end|>"][(i + c) % 4], x) for c in range(4) for i, x in enumerate(odd)]
    log = C.log_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    done = C.rendered(C.folded(log)).select("conv", C.read_back(F.col("formatted")).alias("turns"), C.trained_text(F.col("formatted"), F.col("loss_spans")).alias("said"), "formatted")
    for r in done.collect():
        own = [x for x in rows if x[0] == r["conv"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[2:] for x in own]
        assert r["said"] == "".join(x[3] for x in own if x[2] == "assistant")
        assert r["formatted"].count("</s>") == 0


def test_nulls_ties_and_empty_tables(spark):
    kind = "conv_id long, turn long, role string, text string, conv string, message long"
    rows = [(None, 1, "user", None, "c", 5), (None, None, None, "first", "c", 5), (7, 1, "user", "b", "c", 5), (7, 1, "user", "a", "c", 5), (7, 1, "user", "a", "c", 5)]
    done = {r["conv"]: r["turns"] for r in C.rendered(C.folded(C.log_of(spark.createDataFrame(rows, kind)))).select("conv", C.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [tuple(t) for t in done[None]] == [("", "first"), ("user", "")]
    assert [t["text"] for t in done[7]] == ["a", "a", "b"]
    assert C.rendered(C.folded(C.log_of(spark.createDataFrame([], kind)))).collect() == []
    assert C.folded(spark.createDataFrame([(1, 1, "delta", None, None, "x", ""), (1, 1, "regenerate", 4, None, "x", "")], LOG)).collect() == []
    late = spark.createDataFrame([(1, None, "open", 1, "user", None, ""), (1, 3, "delta", 1, None, "b", ""), (1, 3, "delta", 1, None, "a", "")], LOG)
    assert C.folded(late).collect() == [(1, 1, "user", "ab")]


def test_no_python_in_the_plan(spark):
    plan = C.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
