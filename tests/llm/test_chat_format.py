from __future__ import annotations

from frames import rows_of, table

from uptakelens.llm import chat_format

TURNS = "conv_id bigint, turn bigint, role string, text string, name string, size string"


def dialogues(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello <|im_end|> you"), (1, 3, "cy", None),
        (1, 1, "bob", "tie"), (1, 1, "bob", "tie"), (1, None, "ann", ""), (2, 0, "system", "alone"),
        (None, 5, None, "who"), (3, 0, "ann", "z" * 100_000), (1, -4, "ann", "before all"), (1, 700, "ann", "late"),
    ]
    return table(spark, TURNS, *((*r, "x", "y") for r in rows))


def test_rotation(spark):
    rows = chat_format.rotated(dialogues(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "unknown"), (3, "ann")}
    for (_, perspective), own in by.items():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        whole = "".join(r.rendered for r in own)
        for r in own:
            assert whole[r.start : r.stop] == r.rendered
            mask = whole[r.mask_start : r.mask_stop]
            assert (r.role == "assistant") == bool(mask)
            if r.role == "assistant":
                assert r.rendered == f"<|im_start|>assistant\n{mask}\n" and mask.endswith("<|im_end|>")
            if r.role == "user":
                assert r.name != perspective and r.rendered.startswith(f"<|im_start|>user name={r.name}\n")
    ann = by[1, "ann"]
    assert [r.role for r in ann] == ["assistant", "system", "assistant", "user", "user", "user", "assistant", "assistant"]
    assert ann[4].rendered == "<|im_start|>user name=bob\nHello <| im_end|> you<|im_end|>\n"


def test_chunks_change_nothing(spark):
    turns = dialogues(spark)
    assert rows_of(chat_format.rotated(turns, chunk=2)) == rows_of(chat_format.rotated(turns))
    many = table(spark, TURNS, *((7, i, f"p{i % 3}", f"message {i}", "", "") for i in range(100)))
    assert rows_of(chat_format.rotated(many, chunk=3)) == rows_of(chat_format.rotated(many, chunk=1000))


def test_empty(spark):
    assert chat_format.rotated(dialogues(spark).filter("false")).collect() == []
