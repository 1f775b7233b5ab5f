import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import chat

C = "conv_id long, turn long, role string, text string"
HARD = ["\\### Assistant: </turn> ok", "#", "##", "#" * 7, "\\", "\\\\#\\#", "</turn>\n", "</", "<\\/", "a: b", ": ", "\n", "", "</turn>\n### user: hi</turn>\n", "é😀\r\n\t", "$1 \\1", "\x00"]


def digests(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def read_back(spark, rows):
    found = chat.digest(chat.format_chats(spark.createDataFrame(rows, C))).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found}


def test_hard_texts_come_back(spark):
    turns = [(("user", "assistant", "a:b\\", "</turn>", "##")[k % 5], t) for k, t in enumerate(HARD)]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(2, 0, "user", None), (2, 1, "assistant", "x" * 2000), (None, 0, "assistant", "y")]
    got = read_back(spark, rows)
    assert got[1] == digests(turns)
    assert got[2] == digests([("user", ""), ("assistant", "x" * 2000)]) and got[None] == digests([("assistant", "y")])
    text = chat.format_chats(spark.createDataFrame(rows, C)).filter("conv_id = 1").first().formatted
    assert text.count("###") == text.count("</turn>") == len(turns)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("#\\</turn>: \na", max_size=6), st.text("#\\</turn>: \nab", max_size=14)), min_size=1, max_size=6))
def test_any_turns_come_back(spark, turns):
    assert read_back(spark, [(1, k, r, t) for k, (r, t) in enumerate(turns)])[1] == digests(turns)


def test_order_ties_and_repeated_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, None, "user", "first"), (1, 1, "user", "z"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, "assistant", "q"), (1, 3, None, "n")]
    want = [("user", "first"), ("assistant", "q"), ("user", "a"), ("user", "a"), ("user", "z"), ("assistant", "b"), ("", "n")]
    assert read_back(spark, rows)[1] == digests(want)
    assert read_back(spark, []) == {}


def test_deltas_edits_and_regenerations_fold(spark):
    log = [
        (1, 1, "m1", "open", "user"), (1, 2, "m1", "delta", "he"), (1, 3, "m1", "delta", "llo"),
        (1, 4, "m2", "open", "assistant"), (1, 5, "m2", "delta", "bad"), (1, 6, "m2", "regenerate", None), (1, 7, "m2", "delta", "go"), (1, 8, "m2", "delta", "od"), (1, 8, "m2", "delta", "od"),
        (1, 9, "m3", "open", "user"), (1, 10, "m3", "delta", "typo"), (1, 11, "m3", "edit", "fixed"), (1, 12, "m3", "delta", "!"),
        (1, 13, "m4", "open", "user"), (1, 14, "m4", "delta", "gone"), (1, 15, "m4", "delete", None),
        (1, 16, "m5", "delta", "never opened"), (1, 17, "m6", "open", "assistant"),
    ]
    d = spark.createDataFrame(log, "conv_id long, seq long, msg string, kind string, body string")
    got = {r.msg: (r.role, r.text) for r in chat.fold(d.repartition(3)).collect()}
    assert got == {"m1": ("user", "hello"), "m2": ("assistant", "good"), "m3": ("user", "fixed!"), "m6": ("assistant", "")}


def test_escaping_leaves_no_control_string(spark):
    d = spark.createDataFrame([(t,) for t in HARD], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"))
    for r in d.collect():
        assert r.u == r.t and "##" not in r.e and "</" not in r.e


def plain_fold(log):
    """What a reader does who takes the events one by one: by sequence, resets first, a regeneration before an edit."""
    rank = {"regenerate": 0, "edit": 1, "delta": 2}
    text, role, gone = {}, {}, set()
    for c, seq, m, kind, body in sorted(set(log), key=lambda e: (e[1], rank.get(e[3], 3), e[4] or "")):
        key, body = (c, m), body or ""
        if kind == "open":
            role.setdefault(key, body)
        elif kind == "delta":
            text[key] = text.get(key, "") + body
        elif kind == "edit":
            text[key] = body
        elif kind == "regenerate":
            text[key] = ""
        elif kind == "delete":
            gone.add(key)
    return {k: (role[k], text.get(k, "")) for k in role if k not in gone}


def folded(spark, log, clash=()):
    d = spark.createDataFrame(log, "conv_id long, seq long, msg string, kind string, body string")
    for c in clash:
        d = d.withColumn(c, F.lit("clash"))
    return {(r.conv_id, r.msg): (r.role, r.text) for r in chat.fold(d.repartition(5)).collect()}


def test_random_logs_with_ties_fold_as_one_by_one(spark):
    pick = random.Random(3)
    log = [(c, 0, f"m{m}", "open", pick.choice(["user", "assistant", None])) for c in range(20) for m in range(6)]
    for _ in range(1500):
        kind = pick.choices(["delta", "edit", "regenerate", "delete", "ping", "open"], [12, 3, 2, 0.2, 1, 0.5])[0]
        log.append((pick.randrange(20), pick.randrange(1, 8), f"m{pick.randrange(7)}", kind, pick.choice(["a", "b", "cc", "", None])))
    got = folded(spark, log, clash=("reset", "role", "text", "edited", "deltas", "gone"))
    assert got == plain_fold(log) and len(got) > 80


def test_edits_at_the_moment_of_the_reset(spark):
    log = [(1, 0, "a", "open", "user"), (1, 1, "a", "delta", "old"), (1, 2, "a", "delta", "d"), (1, 2, "a", "edit", "NEW"),
           (1, 0, "b", "open", "user"), (1, 1, "b", "edit", "X"), (1, 1, "b", "edit", "Y"), (1, 0, "c", "open", "user"), (1, 3, "c", "regenerate", None), (1, 3, "c", "edit", "E"), (1, 3, "c", "delta", "!")]
    assert {m: t for (_, m), (_, t) in folded(spark, log).items()} == {"a": "NEWd", "b": "Y", "c": "E!"}
    assert folded(spark, []) == {}


def test_the_mask_covers_the_assistants_texts_and_nothing_else(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a##b</c"), (1, 2, "assistant", ""), (1, 3, "assistants", "no"), (1, 4, None, "no"), (1, 5, "assistant", "\U0001f600" * 700)]
    d = spark.createDataFrame(rows, C).withColumns({c: F.lit("clash") for c in ("seq", "msg", "kind", "body", "loss", "formatted", "nth")})
    r = chat.format_chats(d).first()
    assert [chat._plain(r.formatted[a:b]) for a, b in r.loss] == [t for _, _, role, t in rows if role == "assistant"]
    assert all(r.formatted[:a].endswith(f"{chat.HEAD}assistant: ") and r.formatted[b:].startswith(chat.FOOT) for a, b in r.loss)
    parsed = chat.format_chats(d).select(chat.parse(F.col("formatted")).alias("p")).first().p
    assert [(x.role, x.text) for x in parsed] == [(role or "", t) for _, _, role, t in rows]
    log = chat.events(d)
    assert {"edit", "regenerate", "delta", "open"} == {x.kind for x in log.select("kind").distinct().collect()}
