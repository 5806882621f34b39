import random

import pytest

from polyvec.llm import leaks as L
from polyvec.llm import quality as Q

ITEM = "Serum SHH17 peaks 44 hours past stable kale ingestion, then tracks kale decline rather than vemasol dose. Cheap held-out sensors flag crises 31.5 minutes before alarms sound."


def leaks(text, item=ITEM):
    return bool(L.Items([(1, item)]).leaked(L.normalise(text), 12))


@pytest.mark.parametrize("change", [
    str.upper, lambda t: t.replace(" ", "  \n"), lambda t: t.replace(" ", "&nbsp;"), lambda t: "<p>" + t.replace("kale", "<em class='h'>kale</em>") + "</p>",
    lambda t: t.replace("hours", "ho-\nurs"), lambda t: "> " + t.replace("ingestion", "inges-\n> tion"), lambda t: '{"text": "' + t.replace(" past", "\\npast") + '"}',
    lambda t: t.replace("stable", "st​ab­le"), lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t), lambda t: t.replace("held-out", "held out"),
    lambda t: "".join(c for c in t if c.isalnum() or c in " -"), lambda t: t.replace("peaks", "falls", 1), lambda t: t.replace("past stable", "past very stable"), lambda t: t.replace("tracks ", ""),
    lambda t: t.replace("peaks", "\\u0070eaks"), lambda t: t.replace("kale", "**kale**").replace("than", "`than`"),
])
def test_leaks_in_disguise(change):
    assert leaks("Some text before. " + change(ITEM) + " Some text after.")


def test_leak_length_and_errors():
    words = ITEM.split()
    assert leaks(" ".join(words[3:15])) and not leaks(" ".join(words[3:14]))
    body = words[:24]
    for n, expected in ((2, True), (3, False)):
        changed = list(body)
        for i in (5, 11, 17)[:n]:
            changed[i] = "zzz"
        assert leaks("x " + " ".join(changed[:18] if n == 3 else changed)) == expected
    shuffled = words[:]
    random.Random(1).shuffle(shuffled)
    assert not leaks(" ".join(shuffled)) and not leaks("") and not leaks("a b c", "a b c")


def test_find_leaks(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM, 9), (2, None, 9), (3, "", 9), (4, "nothing of the kind", 9), (5, "y " * 50_000 + ITEM, 9), (1, "x " + ITEM, 9)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "other words " * 10)], "item_id bigint, text string")
    for block in (10**6, 40):
        found = L.find_leaks(docs, "doc_id", "text", items, "item_id", "text", block_bytes=block)
        assert sorted(map(tuple, found.collect())) == [(1, 7), (1, 7), (5, 7)]
    assert {r["doc_id"] for r in L.remove_leaking(docs, "doc_id", found).collect()} == {2, 3, 4}
    assert L.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert L.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


PROSE = "The best source of label is rarely a robust pension. It was dropped in 1971, and nobody has shown that it helped. "
_W = [f"{a}{b}" for a in ("ker", "mol", "tra", "vin", "sor", "pel") for b in ("an", "ide", "ock", "um", "ath", "ing")]
LONG = " ".join(f"The {_W[i]} of the {_W[-i]} was not shown to help any {_W[i * 7 % 36]} in that year." for i in range(1, 36))
CASES = {
    "table": ["a,b,c\n" + "\n".join(f"anchor pooling,{i},0.{i},{i}.5" for i in range(20)), "| k | v |\n|---|---|\n" + "\n".join(f"| row {i} | {i}.5 | {i} |" for i in range(9)), "\n".join(f"12 Q0 N-{i} {i} {30 - i}.000 run3" for i in range(20)), "\n".join(f"late interaction      {i}    0.{i}     0.8   11.5" for i in range(12))],
    "list": ["\n".join(f"- stable {w}" for w in "kale oat rice corn wheat".split()), "Costly Oil\nRaw Levy\nDense Jury\nOral Ward\nAcute Zinc", "raw oil | dense jury | oral ward | acute zinc | stable kale | cold rice", "1. raw oil\n2. dense jury\n10. oral ward", "#raw_oil\n#dense_jury\n#oral_ward\n#x_y"],
    "junk": ["#<+[^%<]]#*]%#>-=_?? /* |!_{[>-/}?># %-[ {/%", "d06a78c70a4f8ce65ee184a66062a017ebc23c9d65ced303ff1c53d0f7f10272", "rural wage sharply! " * 30, "zvfbgd xdpx rhrvhqwk rsjq zkpkwvvskp wqzswrcg ndwxjts", "T h e b e s t s o u r c e o f i t", "Ã\u0083Â©tude Ã\u0083Â©levÃ\u0083Â©e"],
    None: [PROSE, LONG, LONG * 5, PROSE.lower().replace(".", "").replace(",", ""), "在69名样本中，老人明显改变了慢性维生素。早期疫苗预测了维生素。", "the label is rarely\nrobust and the pension\nwas dropped in 1971. It\nis not known if that has\nhelped.", "", "  \n ", "<|im_start|> " + PROSE + "By\tcontrast,\tit is so."],
}


@pytest.mark.parametrize("kind", CASES)
def test_kinds(kind):
    for text in CASES[kind]:
        assert Q.derive(Q.summarise(text))[5] == kind, text[:60]


def test_chunks_merge_to_the_same():
    rng = random.Random(2)
    texts = [t for group in CASES.values() for t in group] + ["\n".join(rng.choice([PROSE, "- raw oil", "a,1,2,3", ""]) for _ in range(60)), PROSE * 30 + "\r\n\r\n" + "x" * 500]
    for text in texts:
        want = Q.derive(Q.summarise(text))
        for size in (7, 50, 333):
            parts = [Q.Summary.unpack(Q.summarise(c).pack()) for c in Q.chunks(text, size)]
            while len(parts) > 1:  # as a tree
                parts = [Q.merge(*parts[i : i + 2]) if len(parts[i : i + 2]) == 2 else parts[i] for i in range(0, len(parts), 2)]
            got = Q.derive(parts[0])
            if size > 40 and "  " not in text and "\t" not in text and "\r" not in text:
                assert got[0] == want[0] and got[1:3] == pytest.approx(want[1:3]) if want[1] else got == want, (size, text[:50])


def test_text_statistics(spark):
    df = spark.createDataFrame([(1, PROSE * 3, "k"), (2, None, "k"), (3, "", "k"), (4, "- a\n- b\n- c", "k"), (5, PROSE * 50, "k"), (5, PROSE * 50, "k")], "doc_id bigint, text string, kind string")
    whole = {tuple(r) for r in Q.text_statistics(df, "doc_id", "text").collect()}
    assert len(whole) == 5 and (2, 0, None, None, None, None, None) in whole and any(r[0] == 4 and r[6] == "list" for r in whole)
    cut = Q.text_statistics(df, "doc_id", "text", chunk=200, fan=4).collect()
    assert len(cut) == 6
    for r in cut:
        w = next(x for x in whole if x[0] == r[0])
        assert tuple(r)[1] == w[1] and tuple(r)[2:6] == pytest.approx(w[2:6]) if w[2] else tuple(r) == w
    assert Q.text_statistics(df.limit(0), "doc_id", "text").count() == 0


NOTICE = " ".join(f"{w}{i}" for i, w in enumerate("this page was saved by an archive whose owner asks readers not to copy or print any part of it for use".split())) + " unless they first write to us here. "
WIDE = " ".join(f"{a}{b}{c}" for a in _W[:12] for b in _W[12:24] for c in "xyz")
IDEOGRAPHS = "".join(chr(0x4E00 + 37 * i) for i in range(30)) + "。"


@pytest.mark.parametrize(("text", "kind"), [
    (NOTICE * 1000, "junk"), (IDEOGRAPHS * 100, "junk"), (NOTICE.replace(" ", "\n") * 40, "junk"),
    (PROSE * 2 + "rural wage sharply! " * 60, "junk"), (WIDE + "\n" + NOTICE * 80, "junk"), (WIDE + " " + NOTICE * 10, None), (NOTICE * 5, None), (LONG * 3 + NOTICE * 7, None),
    ("\n".join(f"{w} {w}x {w}y was seen.\nClick here to share this page with all of your own friends." for w in WIDE.split()), "junk"),
    (" ".join(f"{w}{i}" for i in range(20) for w in WIDE.split()), None), (" ".join(f"{w}{i}" for i in range(20) for w in WIDE.split()) + NOTICE * 1500, "junk"),
])
def test_one_fragment_over_and_over(text, kind):
    assert Q.derive(Q.summarise(text, whole=True))[5] == kind
    for size in (61, 333, 5000):
        if len(text) < 200 * size:
            parts = [Q.Summary.unpack(Q.summarise(c).pack()) for c in Q.chunks(text, size)]
            while len(parts) > 1:
                parts = [Q.merge(*parts[i : i + 2]) if len(parts[i : i + 2]) == 2 else parts[i] for i in range(0, len(parts), 2)]
            assert Q.derive(parts[0])[5] == kind


def test_repeats_do_not_depend_on_cuts():
    rng = random.Random(3)
    text = "".join(rng.choice(["ab ", "cd", "e-f ", "中文", " gh\n", "ij kl mn op qr st "]) for _ in range(900))
    sizes, seen = (1, 2, 5, 17, 60, 10**6), []
    for size in sizes:
        parts = [Q.summarise(text[i : i + size]) for i in range(0, len(text), size)]
        while len(parts) > 1:
            parts = [Q.merge(*parts[i : i + 2]) if len(parts[i : i + 2]) == 2 else parts[i] for i in range(0, len(parts), 2)]
        one = parts[0]
        one.close_words(one.first, 0, 1)
        one.close_words(one.last, Q.EDGE - 1, Q.EDGE)
        seen.append((one.bins.tolist(), one.short.pack(), one.long.pack()))
    assert all(x == seen[-1] for x in seen)


def test_leaks_with_divided_words():
    words = "alpha bravo charlie delta held-out foxtrot golf hotel india juliet kilo lima".split()
    changed = [*words[:4], "held", "out", *words[5:9], "zzz", *words[10:]]
    assert leaks(" ".join(changed), " ".join(words))
    assert not leaks(" ".join(["zzz", *changed[1:]]), " ".join(words))
    words[4] = "end-to-end-run"
    assert leaks("x " + " ".join(changed).replace("held out", "end to end run") + " y", " ".join(words))
    for mark in ("\u00ad\n", "\u00ad \r\n", "\u00ad\u200b\n", "-\u200b\n", "\u00ad"):
        assert L.normalise(f"the inges{mark}tion of") == ["the", "ingestion", "of"]


def test_every_window_with_a_divided_and_a_changed_word_is_looked_up():
    rng = random.Random(4)
    vocabulary = [f"{w}{i}" for i in range(3) for w in _W]
    for _ in range(60):
        words = rng.sample(vocabulary, 12)
        for i in rng.sample(range(12), 3):
            words[i] = words[i] + "-" + rng.choice(_W)
        items = L.Items([(1, " ".join(words))])
        for i in range(1, 11):
            doc = [*words[:i], "zzz", *words[i + 1 :]]
            assert items.leaked(L.normalise(" ".join(doc).replace("-", " ")), 12), (words, i)


def test_markup_of_any_length():
    words = ITEM.split()
    for tag in ('<img alt="' + "z" * 3000 + '">', "<a href='x>y " + "q " * 900 + "'>", "<!-- " + "c " * 999 + "-->", '<p class="a" id=b data-x="' + "1," * 900 + '" hidden>', "<br/>"):
        assert leaks(" ".join(words[:7]) + " " + tag + " " + " ".join(words[7:14])), tag[:30]
    assert leaks("[" + " ".join(words[:7]) + "](https://x.y/" + "z" * 3000 + ' "title") ' + " ".join(words[7:14]))
    assert leaks("if a <b then " + " ".join(words[:14]) + " or c> d")  # not a tag: too many words without a value
    assert L.markup("a < b <c d> <1> <!doctype html> </p>") == [(6, 11, " "), (16, 31, " "), (32, 36, " ")]
    assert L.normalise('x <a title="1 > 0" b>y</a> <em>z</em>w') == ["x", "y", "zw"]


def test_passages_inside_markup_are_found():
    for text in ('<img src=x alt="' + ITEM + '">', "<!-- " + ITEM + " -->", "![" + "x" + "](http://y.z \"" + ITEM + "\")"):
        assert any(L.Items([(1, ITEM)]).leaked(w, 12) for w in L.normalised("before " + text + " after")), text[:20]


@pytest.mark.parametrize("part", ["<!--", "<a ", '<a x="', '="<a"', "](", '](x "', "####", "</b ", "&amp", "[](((", "<a b c ", "á̖", "́", "-\n> ", "\\u00", "%41", "<a b=c "])
def test_normalising_is_linear(part):
    import time

    took = []
    for n in (10_000, 40_000):
        t = time.process_time()
        L.normalised("a-\n" + part * n + "!")
        took.append(time.process_time() - t)
    assert took[1] < 8 * took[0] + 0.5


def test_spans_and_removal(spark):
    copy = "<b>" + ITEM.upper().replace(" ", "&nbsp;", 3).replace("VEMASOL", "ve​masol").replace("DECLINE", "DÉ-\nCLINE") + "</b>"
    text = "Nothing of it here. " + copy + " And a tail of its own…"
    found = L.text_spans(L.Items([(1, ITEM)]), text, 12)
    assert len(found) == 1 and text[found[0][1] : found[0][2]].startswith("SERUM") and text[found[0][1] : found[0][2]].endswith("SOUND")
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing of the kind"), (1, text), (5, ITEM + " and again " + ITEM)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM), (8, "other words " * 10), (None, None)], "item_id bigint, text string")
    args = (docs, "doc_id", "text", items, "item_id", "text")
    for block in (10**6, 40):
        rows = L.leak_spans(*args, block_bytes=block).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(1, 7), (1, 7), (5, 7), (5, 7)]
        clean = {r["doc_id"]: (r["text"], r["removed"]) for r in L.remove_spans(*args, block_bytes=block).collect()}
        assert clean[2] == (None, 0) and clean[3] == ("", 0) and clean[4] == ("nothing of the kind", 0)
        assert clean[1][0] == "Nothing of it here. <b>.</b> And a tail of its own…" and clean[1][1] == len(text) - len(clean[1][0])
        assert clean[5][0] == ". and again ."
    assert L.leak_spans(docs.limit(0), *args[1:]).count() == 0 and L.remove_spans(*args[:3], items.limit(0), *args[4:]).count() == 6


def test_hot_ngrams_align_few_items():
    """Thousands of items with the same beginning: only those that share more than it are aligned."""
    rng = random.Random(6)
    stem = "which of the following statements"
    items = L.Items([(i, stem + " " + " ".join(rng.choice(_W) + str(rng.randrange(10**6)) for _ in range(12))) for i in range(3000)])
    words = (stem + " was ever shown to be of any use to a reader of it ").split() * 50
    assert not list(items.regions(words, 12)) and items.leaked(words + items.words(17), 12)[0][0] == 17


def merged(parts):
    parts = [Q.Summary.unpack(p.pack()) for p in parts]
    while len(parts) > 1:
        parts = [Q.merge(*parts[i : i + 2]) if len(parts[i : i + 2]) == 2 else parts[i] for i in range(0, len(parts), 2)]
    return Q.derive(parts[0])


EDGES = [
    IDEOGRAPHS * 20, "foo.bar,baz(qux)/" * 40, "a\t\tb  c\r\n \r\n\n  x\ty   z\r" * 15, "a&amp;b &nbsp; &lt;p&gt;, it&#39;s&copy " * 12, "QWxhZGRpbjpvcGVuIHNlc2FtZQ1" * 30 + " and so on", "x" * 900 + "\n" + "1,234.50 " * 30,
    " " * 600 + "- an entry" + " " * 700 + "of a list." + " " * 300, "\t- a\n" * 9 + "wait...\"')\n" + "." * 300 + ")" * 300, "d06a78c70a4f8ce65ee184a66062a017ebc23c9d65ced303ff1c53d0f7f10272" * 3, "İstanbul ΣΑΣ naïve 　 é" * 20, "", " ", "\n", "word",
]


@pytest.mark.parametrize("text", [*EDGES, *(t for group in CASES.values() for t in group)])
def test_any_cuts_give_the_whole(text):
    want = Q.derive(Q.summarise(text))
    assert Q.statistics([text, None, text]) == [want, Q.derive(Q.summarise("")), want]
    rng = random.Random(len(text))
    text = text[:4000]
    want = Q.derive(Q.summarise(text))
    for size in (1, 3, 7, 50, 333):
        if len(text) < 150 * size:
            assert merged([Q.summarise(c) for c in Q.chunks(text, size)]) == want, size
    for _ in range(6):
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randint(1, 12)))
        assert merged([Q.summarise(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]) == want, cuts


def test_words_across_cuts_are_counted_once():
    assert merged([Q.summarise(c) for c in Q.chunks("中" * 3000, 450)])[0] == 3000
    assert merged([Q.summarise(c) for c in Q.chunks("foo.bar,baz(qux)/" * 200, 500)])[0] == 800


def test_letter_noise_of_any_alphabetical_spread():
    rng = random.Random(8)
    noise = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(n))
    for n in (12, 80, 400):
        assert Q.statistics([noise("abcdefghijklmnopqrstuvwxyz", n)])[0][5] == "junk"
        assert Q.statistics(["\n".join(noise("abcdefghijklmnopqrstuvwxyz", 3) for _ in range(n))])[0][5] == "junk"
    for prose in ("Die Angstschweißperlen standen ihm auf der Stirn, als er durch die Herbstschlacht ritt und nichts sprach.", "Le quart des élèves suivra les cours pendant les jours froids, puis reviendra chez ses parents.", "El jueves próximo hablaremos de los exámenes y de los objetos perdidos en aquel viaje."):
        assert Q.statistics([prose])[0][5] is None
