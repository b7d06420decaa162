"""Planted swaps of code pages are found and undone; clean texts with odd signs stay."""

import random

import pytest

from tracewell.llm import mojibake as M

CLEAN = [
    "Émeline prépare 14 pêches, ce qui donne 70 au total. Après 36 heures, le nombre de gâteaux a déjà été réduit de moitié.",
    "Für jede Gruppe benötigen wir 8 Körbe, also insgesamt 432. Die übrige Menge ist größer als 24. Während der ersten Stunden ändert sich nichts.",
    "El año pasado había 51 cañas; la diferencia está en la última fila. Cada niño lleva 41 cañas, así que en total hay más.",
    "Сначала было 88 яблок, потом добавили ещё 8. Через 45 часов осталось только 58 коробок.",
    "We can’t divide by zero – so x ≤ 5. It follows that √81 = 9, and 7 × 8 = 56.",
    "每组需要18个盒子，所以一共是810个。 因此答案与计算的顺序无关。",
]
ODD = ["FUNÇÃO Â = 8, Ã = 2", "Σ ± µ ¶ § 47", "┌──┬──┐ │92│23│", "ナニ？ 64個", "😀👍🏽", "שלום 21", "Það er 5", "ecuația cu â și î, 32", "15\xa0km / h", "①②③ ½ ¾ ‰"]
SWAPS = [("utf_8", "cp1252"), ("utf_8", "cp437"), ("utf_8", "mac_roman"), ("utf_8", "cp1251"), ("utf_8", "cp850"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1251", "koi8_r")]


def swap(text, e, d):
    page, out = M.page(d) if d != "gb18030" else None, text.encode(e)
    return "".join(page[b] for b in out)


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(9)
    rows, want, i = [], {}, 0
    for _ in range(60):
        for t in CLEAN:
            rows.append((i, f"{t} {rnd.randrange(100)}", rnd.choice(["a", "b", None])))
            i += 1
    for t in ODD * 3:
        rows.append((i, f"The value is {t} here {rnd.randrange(100)}.", "a"))
        i += 1
    for e, d in SWAPS:
        for t in CLEAN[:5] if e == "utf_8" else CLEAN[3:4] if e == "cp1251" else CLEAN[:3]:
            rows.append((i, swap(t, e, d), "b"))
            want[i] = t
            i += 1
    rows += [(i, "El a�o pasado", "b"), (i + 1, None, "b"), (i + 2, "", None), (i + 3, "plain " * 5000, "a")]
    lost = i
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return {r["doc_id"]: r for r in M.repaired(df).collect()}, want, lost


def test_found(planted):
    got, want, lost = planted
    assert lost in got and got[lost]["n_lost"] == 1
    missed = set(want) - set(got)
    false = set(got) - set(want) - {lost}
    assert len(missed) <= 1 and not false


def test_restored(planted):
    got, want, _ = planted
    right = sum(got[i]["restored"] == t for i, t in want.items() if i in got)
    assert right >= 0.85 * len(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.found(df).count() == 0
    df = spark.createDataFrame([(1, None, None), (2, "only ascii", "x")], "doc_id long, text string, source string")
    assert M.found(df).count() == 0


def test_single_word_keys():
    c = M.Ciphers()
    for e, d in SWAPS:
        word = "élèves" if e != "cp1251" else "яблок"
        k = M.KEYS.index((e, d))
        assert c.decode(swap(word, e, d), k) == word


def test_very_long_runs(spark):
    rows = [(1, "éa" * 100_000, "s"), (2, "a" * 200_000, "s"), (3, "中" * 100_000, "s"), (4, "a " * 50_000 + "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert M.found(df).count() == 0


def test_mapping_of_an_unlisted_page(spark):
    """A source read with a pair of pages that no list holds: its letters are learned from its own words."""
    rnd = random.Random(4)
    cons, vowels = "bdgklmnprstvčšž", "aeioyąęėįųū"
    after = {c: rnd.choices(vowels, k=3) for c in cons} | {v: rnd.choices(cons, k=4) for v in vowels}  # letters have their usual successors
    def word():
        w = rnd.choice(cons)
        while len(w) < 3 or rnd.random() < 0.75:
            w += rnd.choices(after[w[-1]], (6, 3, 1, 1)[: len(after[w[-1]])])[0]
        return w

    vocabulary = [word() for _ in range(500)]
    say = lambda: " ".join(rnd.choice(vocabulary) for _ in range(12))
    rows = [(i, say(), rnd.choice("ab")) for i in range(600)]
    letters = "čšžąęėįųū"
    signs = rnd.sample("ßþðøæœŁłđħŋŧĸĳ", len(letters))
    table = str.maketrans(dict(zip(letters, signs)))
    planted = {1000 + i: say() for i in range(150)}
    rows += [(i, t.translate(table), "c") for i, t in planted.items()]
    got = {r["doc_id"]: r for r in M.repaired(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(set(planted) & set(got)) >= 0.9 * len(planted) and not set(got) - set(planted)
    words = [(a, b) for i, t in planted.items() if i in got for a, b in zip(t.split(), got[i]["restored"].split())]
    assert sum(a == b for a, b in words) >= 0.8 * len(words) and any("learned" in r["keys"] for r in got.values())


def test_hidden_letters_sum_to_one():
    lang = M.Language(*map(M.np.array, zip(*[(c, 5.0) for w in ("éta", "àté", "téà") for c in M.pair_codes(w)])))
    letters = M.Letters(lang)
    channel = {y: M.np.ones(len(letters.letters)) for y in "ßø"}
    got, p = M.hidden_letters("taßøt", letters, channel)
    assert len(got) == 2 and all(abs(x.sum() - 1) < 1e-9 for _, x in got) and p > 0


def test_more_sources_than_numbers():
    few, many = M.Sources(["b", None, "a"]), M.Sources([str(i) for i in range(M.MAX_SOURCES + 1)])
    assert len({few.of(x) for x in ("a", "b", None)}) == 3 and many.number is None and 0 <= many.of("zz") < M.MAX_SOURCES
