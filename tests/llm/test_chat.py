"""Formatted turns come back unchanged; masks cover assistant texts alone."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from segmill.llm import chat
from segmill.llm.tables import vocabulary
from segmill.llm.vocabularies import decode
from tests.llm.fixtures import LONG, nothing

TURNS = [
    (1, 0, "system", "be \\[INST] kind"),
    (1, 1, "user", None),
    (1, 2, "assistant", "</s>[INST] ok [/INST] \\ \\\\ <s>\n"),
    (1, 2, "assistant", "tie"),
    (1, 2, "assistant", "tie"),
    (1, 3, None, ""),
    (2, 0, "as</s>sistant", "été \U0001d4b3 [INST"),
    (2, None, "assistant", LONG),
    (None, 0, "assistant", "]"),
    (3, 700, "user", "late"),
    (3, 0, "assistant", "early"),
]


def _table(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    return rows.withColumns({"ids": F.lit("clash"), "n_ids": F.lit(1)})


def test_escaping_is_reversible_and_breaks_controls():
    for text in ("", "\\", "<s>", "<\\s>", "[/INST][INST]", "<<s>s>", "\\</s>\\", "a\nb"):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(x in chat.escape(text) for x in chat.CONTROLS)


def test_digests(spark):
    shared = vocabulary(spark, "byte_bpe_50k.tiktoken")
    turns = chat.format_turns(_table(spark), shared)
    got = {r.conv_id: r for r in chat.read_back(turns, shared).collect()}
    by = {}
    for conv, turn, role, text in TURNS:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by)
    for conv, rows in by.items():
        if conv == 1:  # ties are ordered by ids
            rows = rows[:2] + sorted(rows[2:5], key=lambda r: r[2] == "tie") + rows[5:]
            options = [rows, rows[:2] + rows[3:5] + rows[2:3] + rows[5:]]
        else:
            options = [sorted(rows)]
        digests = []
        for option in options:
            loss = "".join(t for _, r, t in option if r == "assistant")
            whole = "".join(f"{r}\n{t}\n" for _, r, t in option)
            digests.append((len(option), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        row = got[conv]
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) in digests
        assert row.formatted_chars == sum(len(chat.escape(r)) + len(chat.escape(t)) + 20 for _, r, t in rows)
    assert chat.read_back(chat.format_turns(nothing(_table(spark)), shared), shared).count() == 0


def test_offsets_and_masks(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 2)
    shared = vocabulary(spark, "byte_bpe_50k.tiktoken")
    rows = chat.format_turns(_table(spark).where("conv_id = 1"), shared).orderBy("id_offset").collect()
    at = chars = 0
    for row in rows:
        assert (row.id_offset, row.char_offset) == (at, chars)
        at, chars = at + row.n_ids, chars + row.n_chars
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    trained = [decode(shared.value, ids[r.loss_start : r.loss_end]).decode() for r in rows if r.role == "assistant"]
    assert sorted(map(chat.unescape, trained)) == sorted(t for c, _, r, t in TURNS if c == 1 and r == "assistant")
    assert all((r.loss_start is None) == (r.role != "assistant") for r in rows)
