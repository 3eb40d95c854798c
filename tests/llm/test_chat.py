import hashlib

from conftest import TESTDATA
from llm_rows import doc_rows

from lodgeframe.llm import chat, queries
from oracle import compare, connect

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a </turn>\n<turn assistant>\nb \\l \\ < > # ###"), (1, 2, "assistant", "c\\\\<"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "user", "no answer"), (3, 1, "assistant", "second"), (3, 0, "assistant", "first"),
    (4, 1, "user", "tie b"), (4, 1, "user", "tie a"), (4, 1, "user", "tie a"), (4, None, None, "no number"), (None, 0, "user", "no id"),
    (5, 0, "we<ird>\nrole", "x"), (5, 1, "assistant", "ok " * 20000), (6, 0, "assistant", "aaa"), (6, 1, "assistant", "aaa"), (7, 0, "user", "é\U0001f600"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id long, turn long, role string, text string, id string, formatted string, rows string")


def test_reads_back_what_was_said(spark):
    formatted = chat.format_conversations(frame(spark, TURNS)).collect()
    assert len(formatted) == len({t[0] for t in TURNS})
    for row in formatted:
        own = sorted(((n is not None, n or 0, r or "", t or "") for c, n, r, t in TURNS if c == row["id"]))
        assert chat.read_turns(row["formatted"]) == [(r, t) for _, _, r, t in own] and not row["rewrites"]
        assert [chat.unescape(row["formatted"][s["start"] : s["end"]]) for s in row["loss_spans"]] == [t for _, _, r, t in own if r == "assistant"]
        ends = [0, *[t["end"] for t in row["turns"]]]
        assert [t["start"] for t in row["turns"]] == ends[:-1] and ends[-1] == len(row["formatted"])
    found = {r["id"]: r for r in chat.digests(chat.format_conversations(frame(spark, TURNS))).collect()}
    assert found[3]["loss_sha256"] == hashlib.sha256(b"firstsecond").hexdigest() and found[3]["loss_chars"] == 11
    assert found[2]["loss_chars"] == 0 and found[None]["n_turns"] == 1


def test_templates_that_rewrite_history():
    def hides_old_answers(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 or r != 'assistant' else '...'}" for k, (r, t) in enumerate(turns))

    def counts(turns):
        return f"{len(turns)} turns:" + "".join(t for _, t in turns)

    turns = [("user", "a"), ("assistant", "bbb"), ("user", "c")]
    assert chat.render(hides_old_answers, turns)[2] and chat.render(counts, turns)[2]
    assert not chat.render(hides_old_answers, turns[:2])[2]
    output, spans, rewrites = chat.render(lambda ts: "<s>" + "".join(f"{r}:{t}|" for r, t in ts), turns)
    assert not rewrites and [output[s[1] : s[2]] for s in spans] == ["a", "bbb", "c"]


def test_escapes_are_reversible_and_hide_marks():
    for _, text, _ in doc_rows(5):
        for own in (text or "", (text or "") + "\\<turn a>\n</turn>\\l\\\\g#"):
            assert chat.unescape(chat.escape(own)) == own and not set("<>#") & set(chat.escape(own))


def test_equals_sql(spark, tmp_path):
    assert compare(queries.op8_chat(spark, TESTDATA), connect(TESTDATA), queries.OP8_SQL) is None
    rows = [t for t in TURNS if t[0] is not None]
    frame(spark, rows).select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = connect("/nowhere")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert compare(queries.op8_chat(spark, str(tmp_path)), con, queries.OP8_SQL) is None


def test_large_ids_beside_a_null_stay_whole(spark):
    rows = [(2**53 + 1, 0, "user", "a"), (None, 0, "assistant", "b"), (2**53 + 3, 0, "user", None)]
    formatted = chat.format_conversations(frame(spark, rows).coalesce(1))
    assert {r["id"] for r in formatted.collect()} == {r["id"] for r in chat.digests(formatted).collect()} == {r[0] for r in rows}


def test_empty(spark):
    assert chat.digests(chat.format_conversations(frame(spark, []))).count() == 0
