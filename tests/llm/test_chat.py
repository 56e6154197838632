import hashlib
import re

from citeweave.llm import chat

HARD = ["", "plain", "</turn>", "### user: x</turn>", "a\\e\\t\\h", "\\", "\\\\", "\\\\t", "### ", "x</turn></turn>", "é\n\n\U0001d54f", "### Assistant: </turn> ok", "<\\/turn>", "\\</turn>"]


def test_every_conversation_comes_back(spark):
    rows = [(c, t, role, HARD[(c * 7 + t) % len(HARD)]) for c in range(20) for t, role in enumerate(["user", "assistant", "system", "assistant"])]
    rows += [(50, None, None, None), (50, 1, "we:ird\nrole", "b"), (51, 0, "assistant", "twice"), (51, 0, "assistant", "twice"), (None, 0, "user", "no id"), (52, 0, "assistant", "z" * 50000)]
    frame = chat.with_probe(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    shown = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    by = {}
    for c, t, role, text in [*rows, *chat.PROBE]:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for r, x in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
        assert got[c].formatted_chars == len(shown[c].formatted)
        if shown[c].level == 1:
            assert shown[c].formatted.count("</turn>") == len(turns)
    assert shown[-7].level == 1


def test_empty_and_native(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(none)).count() == 0
    plan = chat.digests(chat.format_conversations(none))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
