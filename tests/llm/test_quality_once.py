"""op3 looks its words up once for votes and features."""

import random

from sparkweave.llm import quality as Q


def test_votes_from_places_equal_votes_from_texts(monkeypatch):
    rng, made = random.Random(3), []
    monkeypatch.setattr(Q, "_places", Q.Memo(lambda w, f=Q._places.function: made.append(w) or f(w)))
    some = ["the ", "Of, ", "###x ", "WORD! ", "a-b ", "x_y ", "ΣΑΣ ", "İ ", "été. ", " ", "\n", "x1 ", "中文 "]
    texts = [None, "", " \n", *("".join(rng.choice(some) for _ in range(rng.randint(1, 90))) for _ in range(300))]
    for text in texts:
        at = Q.places(text)
        assert Q.votes(text, at) == Q.votes(text)
        assert [x.tolist() for x in Q.features(text, at)] == [x.tolist() for x in Q.features(text)]
    assert len(made) == len(set(made))  # whatever asks for it, a word is worked out once
