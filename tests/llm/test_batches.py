"""Texts of a batch are encoded together."""

from latticeworks.llm.tokens import Encoder, local_path


def test_a_batch_goes_to_the_tokenizer_in_few_calls(monkeypatch):
    texts = ["", "Hello new world.", "  odd  white space ", "one\ntwo, three", "\x1crare", "x" * 60 + " long " + "x" * 60, "Hello again, wörld"] * 20
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, calls = Encoder(local_path(file)), []
        want = [e.ids(t) for t in texts]
        assert want == [e._encode([t])[0] for t in texts]
        e.runs.clear()
        encode = e._encode
        monkeypatch.setattr(e, "_encode", lambda own: calls.append(len(own)) or encode(own))  # noqa: B023
        assert e.all_ids(texts) == want and len(calls) < 6
        assert all(len(x) <= 40 for x in e.runs)
