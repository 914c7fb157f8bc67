import random
import re
import textwrap

from sparkweave.llm import licenses as L


def test_rules_over_wrapped_and_reordered_texts(spark):
    s = L.SENTENCES
    mit = ". ".join(s[k] for k in ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")) + "."
    apache = f"{s['apache-notice']} (the \"License\"); {s['apache-use']}. {s['apache-copy']} http://example.org/. {s['apache-basis']}. {s['apache-see']}."
    cases = {
        1: ("The title\n" + textwrap.fill(mit, 60), [("mit-full", "MIT", 4)]),
        2: ("# " + apache.replace(" ", "\n# ", 20), [("apache-header", "Apache-2.0", 5)]),
        3: ("Foo bar.\nReleased under the MIT License.\nMore. Licensed under CC BY-NC 4.0.", [("mit-released", "MIT", 1), ("cc-by-nc", "CC-BY-NC-4.0", 1)]),
        4: (". ".join(s[k] for k in ("mit-condition", "mit-grant")), [("mit-short", "MIT", 1)]),
        5: (". ".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")), [("bsd-2", "BSD-2-Clause", 3)]),
        6: (". ".join(s[k] for k in ("bsd-grant", "bsd-source")) + " x" * 41 + ". " + s["bsd-binary"], []),
        7: ("we were released under the mit license", []),
        8: (None, []), 9: ("", []), 10: ("İİ. Licensed under the Apache License, Version 2.0.", [("apache-short", "Apache-2.0", 1)]), 11: ("license " * 50000, []),
    }
    rows = [(k, t, 1) for k, (t, _) in cases.items()] + [(None, cases[3][0], 2), (3, cases[3][0], 3)]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string, start int")).collect()
    for k, (text, want) in cases.items():
        mine = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["start"])
        assert [(r["rule"], r["license"], r["n_sentences"]) for r in mine] == sorted(want * (2 if k == 3 else 1), key=lambda w: want.index(w))
        assert all(0 <= r["start"] < r["end"] <= len(text) for r in mine)
    assert sum(r["doc_id"] is None for r in got) == 2
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_sentence_is_recognised_alone():
    rng = random.Random(1)
    recogniser = L.Recogniser(L.SENTENCES, L.RULES)
    for name, sentence in L.SENTENCES.items():
        noise = " ".join(rng.choice("qwertz") for _ in range(20))
        assert [x[0] for x in recogniser.sentences(f"{noise}.\n{sentence.upper()}\n{noise}")] == [name]


def test_tables_are_consistent():
    assert {n for *_, names in L.RULES for n in names} == set(L.SENTENCES)


def by_trying_all(text):
    """Every sentence at every place, and every rule at every place of the sequence."""
    low = text.lower()
    found = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W_]+", low)]
    words = [w for w, _, _ in found]
    known = {name: re.findall(r"[^\W_]+", x.lower()) for name, x in L.SENTENCES.items()}
    seen, i = [], 0
    while i < len(words):
        fits = [n for n, k in known.items() if words[i : i + len(k)] == k and (i == 0 or re.search(r"[\n.!?:;,(\"*#/-]", low[found[i - 1][2] : found[i][1]]))]
        if fits:
            name = min(fits, key=lambda n: (-len(known[n]), n))
            seen.append((name, i, i + len(known[name])))
            i += len(known[name])
        else:
            i += 1
    out, i = [], 0
    while i < len(seen):
        fits = [r for r in L.RULES if tuple(x[0] for x in seen[i : i + len(r[3])]) == r[3] and all(b[1] - a[2] <= L.GAP for a, b in zip(seen[i : i + len(r[3])], seen[i + 1 : i + len(r[3])]))]
        best = min(fits, key=lambda r: (-len(r[3]), r[0]), default=None)
        if best:
            out.append((best[0], best[1], len(best[3])))
        i += len(best[3]) if best else 1
    return out


def test_against_trying_all():
    rng = random.Random(8)
    names, sequences = list(L.SENTENCES), [r[3] for r in L.RULES if len(r[3]) > 1]
    recogniser, many = L.Recogniser(L.SENTENCES, L.RULES), 0
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += rng.choice(sequences) if rng.random() < 0.5 else [rng.choice(names)]
            if rng.random() < 0.3:
                parts.pop(rng.randrange(len(parts)))
        text = ""
        for n in parts:
            text += rng.choice(["\n", ". ", " ", "; ", " word. ", "\n" + "x " * rng.choice([3, 39, 41]) + "\n"]) + rng.choice([str, str.upper, str.lower])(L.SENTENCES[n])
        got = [(m[0], m[1], m[3]) for m in recogniser.matches(text)]
        assert got == by_trying_all(text), text
        many += sum(n > 1 for *_, n in got)
    assert many > 100


def test_every_rule_and_every_tag():
    recogniser = L.Recogniser(L.SENTENCES, L.RULES)
    for rule, licence, kind, names in L.RULES:
        assert [(m[0], m[1]) for m in recogniser.matches(".\n".join(L.SENTENCES[n] for n in names))] == [(rule, licence)]
    assert [m[1] for m in recogniser.matches("// SPDX-License-Identifier: GPL-2.0-or-later\n# SPDX-License-Identifier: Apache-2.0\n")] == ["GPL-2.0-or-later", "Apache-2.0"]
