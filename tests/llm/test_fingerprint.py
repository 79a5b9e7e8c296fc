"""A text's fingerprint depends on the text alone."""

from __future__ import annotations

from scriptoria.llm import fingerprint


def test_a_fingerprint_is_the_same_alone_and_beside_a_long_text():
    long = " ".join(f"word{i % 977} then{i % 13}" for i in range(20_000))
    for text in ("x", "ab", "aaaa", "a few words", "one two three four five six seven"):
        alone = fingerprint.to_text(fingerprint.sketches([text]))[0]
        assert alone == fingerprint.to_text(fingerprint.sketches([text, long]))[0]
        assert alone == fingerprint.to_text(fingerprint.sketches(["y", text]))[1]
        assert alone.strip("-")
    assert not fingerprint.to_text(fingerprint.sketches(["", long]))[0].strip("-")
