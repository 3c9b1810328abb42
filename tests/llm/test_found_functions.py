"""Pure parts of the operators on hand-made cases."""

import random

import numpy as np
import pytest

from folioloom.llm import bitext as B
from folioloom.llm import languages as G
from folioloom.llm import lookalike as L
from folioloom.llm import names as N
from folioloom.llm import packing as P
from folioloom.llm import sentences as S


@pytest.mark.parametrize("stored, form", [
    ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("zero​width­", "zerowidth"), ("é", "é"), ("ﾊﾞｼﾞ", "バジ"), ("a b", "a b"), ("ﬁn", "fin"),
    ("⽔", "水"), ("豈", "豈"), ("non‑break", "non-break"), ("甲‧乙∙丙・丁", "甲·乙·丙·丁"), ("①½…", "①½…"), ("！。", "!。"), ("", ""), ("two  blanks", "two  blanks"),
])
def test_one_code_for_one_look(stored, form):
    assert L.uniform(stored) == form


def test_candidates_of_mixed_tokens():
    assert "Joaquín" in L.candidates("Jοaquín", "Jοaquín came")
    assert "estación" in L.candidates("estaciόn", "la estaciόn")
    assert L.candidates("а", "thе house а day") == ["a"] and L.candidates("а", "а") == []
    assert L.candidates("пpивет", "пpивет, мир") == ["привет"] and L.candidates("λoγος", "λoγος") == ["λογος"]
    assert L.suspects("plain") == [] and L.suspects("он сказал а потом с ней") == [] and L.suspects("чисто") == []
    assert L.suspects("он сказал: house of major c words а") == []
    assert L.repaired("thе end", {"thе": "the"}) == "the end"
    assert L.uniform("𝐀𝑏𝟏") == "Ab𝟏"


MODEL = S.fit(np.zeros(S.TABLE, np.int64))


@pytest.mark.parametrize("text, units", [
    ("Dr. Paz came. He left.", ["Dr. Paz came.", "He left."]),
    ("It rose 2.5 metres. See vol. 3, p. 7.", ["It rose 2.5 metres.", "See vol. 3, p. 7."]),
    ("The R.T.R. office closed.Then rain.", ["The R.T.R. office closed.", "Then rain."]),
    ("“Go!” said Ana. “Stay. Wait.” Night fell.", ["“Go!” said Ana.", "“Stay.", "Wait.”", "Night fell."]),
    ("He said: “Go. Now.” She left.", ["He said: “Go. Now.”", "She left."]),
    ("He (oh no!) left. Good", ["He (oh no!) left.", "Good"]),
    ("“走。”他说。“来！”天亮了。", ["“走。”他说。", "“来！”", "天亮了。"]),
    ("「走れ。」と彼は言った。雨だ！？終わり", ["「走れ。」と彼は言った。", "雨だ！？", "終わり"]),
    ("第一章\n水涨了9.5米。富.科．科托斯来了。", ["第一章", "水涨了9.5米。", "富.科．科托斯来了。"]),
    ("— Vem! — disse Ana. Fim.", ["— Vem! — disse Ana.", "Fim."]),
    ("«¡No!», dijo él. At 6 p.m. Ana slept.", ["«¡No!», dijo él.", "At 6 p.m. Ana slept."]),
    ("Ropes, etc. were left... and then gone.", ["Ropes, etc. were left... and then gone."]),
    ("", []), (None, []), ("  \n　", []), ("\U00020bb7\U00020bb7。b", ["\U00020bb7\U00020bb7。", "b"]),
])
def test_sentence_units(text, units):
    (spans,) = S.split_many([text], MODEL)
    assert [text[s:e] for s, e in spans] == units


def test_prefixes_and_lists_decide_nothing_by_length():
    for n in (390, 420, 3000):
        (spans,) = S.split_many(["“走吧。”" + "他" * n + "说。然后他走了。"], MODEL)
        assert len(spans) == 2
    assert S.left_word("x " + "a" * 90 + ".", 92) == "a" * 90 and S.left_word("I.B.M.", 5) == "I.B.M" and S.left_word("A.I.B.M.", 7) == "I.B.M"


@pytest.mark.parametrize("blank, words, mark", [(" ", "ana luis rosa juan hid sold drew fed the a clock hen net goat kitchen bridge near under by well".split(), ". "), ("", list("安娜路易斯藏卖画喂钟鸡网羊厨房桥附近下井边的"), "。")])
def test_sentences_without_marks(blank, words, mark):
    rng = random.Random(4)
    def sentence():  # noqa: E306
        who, what, thing, near, place = (words[i::5] for i in range(5))
        return blank.join([rng.choice(who), rng.choice(what), words[8], rng.choice(thing), rng.choice(near), rng.choice(place)])

    table = np.zeros(S.TABLE, np.int64)
    for _ in range(400):
        S.ngrams.count(mark.join(sentence() for _ in range(5)) + mark.strip(), table[S._GRAMS :])
    model = S.fit(table)
    hit = found = total = 0
    for _ in range(200):
        some = [sentence() for _ in range(4)]
        text = blank.join(some)
        (spans,) = S.split_many([text], model)
        ends, at = set(), 0
        for x in some:
            ends.add(at + len(x))
            at += len(x) + len(blank)
        hit, found, total = hit + len(ends & {e for _, e in spans}), found + len(spans), total + 4
    assert hit / total >= 0.9 and hit / found >= 0.9


def test_tokens_of_long_texts_are_counted_by_stretches(monkeypatch):
    from folioloom.llm import ngrams

    text = "".join(random.Random(1).choices(["word ", "ana ", "ok. ", "你好", "。", "\n", "long" * 30 + " ", "𠮷"], k=3000))
    whole = np.zeros(ngrams.TABLE, np.int64)
    ngrams.count(text, whole)
    for size in (50, 333, 4000):
        monkeypatch.setattr(ngrams, "STRETCH", size)
        parts = np.zeros(ngrams.TABLE, np.int64)
        ngrams.count(text, parts)
        assert (parts == whole).all()


def test_posteriors_without_marks_match_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 6):
        odds = rng.normal(0, 2, n)
        weight = {}
        for m in range(1 << n):
            cuts = [i for i in range(n) if m >> i & 1]
            sizes = np.diff([-1, *cuts, n])  # tokens of each sentence
            weight[m] = np.exp(sum(odds[i] for i in cuts) + S.FEWER * sum(s < S.SHORT for s in sizes))
        want = [sum(w for m, w in weight.items() if m >> i & 1) / sum(weight.values()) for i in range(n)]
        assert np.allclose(S.apart(odds), want)


def test_units_cover_everything_but_blanks():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices(["a", "B", ".", "。", "！", " ", "“", "”", "（", "）", "\n", "3", "Dr", "…", "，", "他说", "："], k=rng.randint(0, 40)))
        (spans,) = S.split_many([text], MODEL)
        covered = set()
        for s, e in spans:
            assert s < e and not text[s].isspace() and not text[e - 1].isspace() and "\n" not in text[s:e]
            assert not covered & set(range(s, e))
            covered |= set(range(s, e))
        assert all(text[i].isspace() for i in set(range(len(text))) - covered)


def test_long_line_takes_no_long_time():
    import time

    text = "“Go!” said Ana (oh!). He left. " * 20_000
    began = time.time()
    (spans,) = S.split_many([text], MODEL)
    assert len(spans) == 40_000 and time.time() - began < 20


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        odds, near = rng.normal(0, 2, n), rng.random(n) < 0.5
        weight = {}
        for m in range(2 ** n):
            e = [(m >> i) & 1 for i in range(n)]
            w = sum(o for o, x in zip(odds, e) if x) - 9 * sum(1 for i in range(n) if e[i] and near[i] and (i == 0 or e[i - 1]))
            weight[tuple(e)] = np.exp(w)
        z = sum(weight.values())
        want = [sum(v for k, v in weight.items() if k[i]) / z for i in range(n)]
        assert np.allclose(S.posteriors(odds, list(near)), want) or not near.any()


def test_labels_and_sentences_of_languages():
    assert [G.stated(x) for x in ("EN_gb", "zho", "Portuguese", "und", "", None, "es-MX")] == ["en", "zh", "pt", None, None, None, "es"]
    assert G.is_sentence("Ana slept in the kitchen.") and G.is_sentence("他在厨房睡觉。")
    assert not any(map(G.is_sentence, ("Chapter 3", "第十章", "***", "Ahhhhhhh.", "啊啊啊啊啊。", "")))


def test_mixture_takes_a_language_only_if_it_pays():
    clear = np.array([[0.0, -40, -40, -40, -40], [0.0, -40, -40, -40, -40], [-40, 0.0, -40, -40, -40]])
    m = G.mixture(clear, 200)
    assert set(m.languages) == {0, 1} and m.shares.sum() == pytest.approx(1) and m.posterior.argmax(1).tolist() == [0, 0, 1]
    doubtful = np.array([[0.0, -40, -40, -40, -40], [0.0, -40, -40, -40, -40], [-1.0, 0.0, -40, -40, -40]])
    assert G.mixture(doubtful, 200).languages == [0]


def optimum(items, capacity):
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0] and k < len(items):
            return
        if k == len(items):
            best[0] = min(best[0], len(rooms))
            return
        for i in sorted(set(range(len(rooms))), key=lambda i: rooms[i]):
            if rooms[i] >= items[k]:
                go(k + 1, rooms[:i] + [rooms[i] - items[k]] + rooms[i + 1 :])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


def test_bin_completion_against_all_packings():
    rng = random.Random(4)
    worse = 0
    for _ in range(120):
        capacity = rng.randint(5, 30)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 8))), reverse=True)
        counts = {s: items.count(s) for s in items}
        packing = P.complete(counts, capacity)
        used = [s for f in packing.fillings for s in f.sizes for _ in range(f.times)]
        assert sorted(used) == sorted(items) and all(sum(f.sizes) <= capacity for f in packing.fillings)
        best = optimum(items, capacity) if items else 0
        assert P.lower_bound(counts, capacity) <= best <= packing.containers <= P.best_fit(counts, capacity).containers
        worse += packing.containers > best
    assert worse == 0


def test_bin_completion_tries_all_undominated_fillings():
    items = [12, 19, 20, 27, 29, 31, 42, 42, 46, 53, 58, 59, 60]
    best = P.complete({s: items.count(s) for s in items}, 100)
    assert best.containers == 5 and best.proved
    rng, proved = random.Random(12), 0
    for _ in range(20):
        items = [rng.randint(20, 700) for _ in range(120)]
        best = P.complete({s: items.count(s) for s in items}, 1000)
        assert best.containers - P.lower_bound({s: items.count(s) for s in items}, 1000) <= 1
        proved += best.proved
    assert proved >= 10  # the others end with their steps, one container above the bound


def test_fillings_are_those_that_none_dominates():
    def dominated(f, g):
        """Whether the items of f go into those of g, each g item holding some of f."""
        if not f:
            return f != g
        return any(dominated(f[1:], tuple(sorted((*g[:i], g[i] - f[0], *g[i + 1 :]), reverse=True))) for i in range(len(g)) if g[i] >= f[0])

    rng = random.Random(5)
    for _ in range(60):
        room, items = rng.randint(4, 16), [rng.randint(1, 12) for _ in range(6)]
        sizes, counts = np.unique(items, return_counts=True)
        got = list(P.fillings(room, sizes, counts, lambda: room, lambda: True))
        every = {tuple(sorted((x for k, x in enumerate(items) if m >> k & 1), reverse=True)) for m in range(1 << 6)}
        every = {f for f in every if sum(f) <= room}
        kept = {f for f in every if not any(dominated(f, g) for g in every if g != f and (sum(g) > sum(f) or sum(g) == sum(f) and len(g) < len(f)))}
        assert set(got) == kept and len(got) == len(kept)


def test_numbers_of_two_languages():
    assert B.numbers("他数了三十八页，七枚，星期六，第三次，两排", True) == {38, 7}
    assert B.numbers("thirty-eight pages, seven coins and 115 pesos, one, two", False) == {38, 7, 115}


def test_path_over_lengths_alone():
    m = B.Model({}, 2.0, 4.0)
    unit = lambda i, n: B.Unit(i, n, np.array([0]), frozenset())
    a, b = [unit(0, 10), unit(1, 50), unit(2, 12)], [unit(0, 20), unit(1, 101), unit(2, 25)]
    assert B.best_path(a, b, m, None) == [([0], [0]), ([1], [1]), ([2], [2])]
    merged = B.best_path([unit(0, 40), unit(1, 42)], [unit(0, 165)], m, None)
    assert merged == [([0, 1], [0])]
    assert B.best_path([], [], m, None) == [] and B.best_path(a, [], m, None) == []


def test_clauses_keep_every_character():
    stock = {"on monday": True, "in spite of the fever": False}
    text = "On Monday, Ana hid the clock, in spite of the fever, then Luis found it; nobody knew why they did."
    found = B.clauses(text, stock)
    assert "".join(found).replace(" ", "") == text.replace(" ", "") and len(found) == 3


@pytest.mark.parametrize("text, want", [
    ("Cnel. Amparo L. Ronase Segundo", ((), (), ("amparo", "l.", "ronase"), True, "")),
    ("Ronase, A. L., Jr.", (("a.", "l."), ("ronase",), (), True, "")),
    ("Bot. Tusamor e hjs., Río Manso", ((), ("tusamor",), (), False, "pharmacy")),
    ("Compañía Betumas y Cía. e Hijos", ((), ("betumas",), (), False, "company")),
    ("F.C. Quilar d. Boca Vieja", ((), ("quilar",), (), False, "railway")),
])
def test_latin_forms(text, want):
    f = N.read_latin(text)
    assert (f.given, f.surname, f.loose, f.junior, f.firm) == want


@pytest.mark.parametrize("text, want", [
    ("安帕罗·罗纳塞第二", (("安帕罗", "罗纳塞"), True, False, "")), ("小安帕罗·罗纳塞", (("安帕罗", "罗纳塞"), True, False, "")),
    ("老罗纳塞", (("老罗纳塞",), False, True, "")), ("罗纳塞父子药房", (("罗纳塞",), False, False, "pharmacy")), ("安帕罗．罗纳塞（子）", (("安帕罗", "罗纳塞"), True, False, "")),
])
def test_chinese_forms(text, want):
    f = N.read_chinese(text)
    assert (f.parts, f.junior, f.vague, f.firm) == want


def test_distances():
    assert [N.edit_distance(a, b) for a, b in (("abc", "acb"), ("abc", "abc"), ("abcd", "xbcd"), ("a", "abcdef"))] == [1, 0, 1, 4]
    assert N.edit_distance("a" * 100, "a" * 99 + "b") == 4
    assert set(N.deletions("ab")) == {"ab", "a", "b"}


def test_close_words_share_a_key():
    rng = random.Random(4)
    slips = (lambda w, i: w[:i] + rng.choice("abc") + w[i + 1 :], lambda w, i: w[:i] + w[i + 1 :], lambda w, i: w[:i] + rng.choice("abc") + w[i:], lambda w, i: w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :])
    keys = lambda w: set(N.deletions(w, 2 if len(w) >= 6 else 1))
    assert N.close("famotaz", "femotez") and keys("famotaz") & keys("femotez")
    for _ in range(3000):
        a = b = "".join(rng.choices("abc", k=rng.randint(3, 9)))
        for _ in range(2):
            b = rng.choice(slips)(b, rng.randrange(len(b) + 1))
        if N.close(a, b):
            assert keys(a) & keys(b), (a, b)


def test_given_names_not_learned_stand_for_themselves():
    known = N.Lexicon({"amparo": "amparo"})
    p = N.profile("Xavier Ronase", ["Xavier Ronasse", "Quirina Ronaze"], {}, known)
    assert p.given == [{"xavier"}] and p.latin == {"ronase", "ronasse"}
    assert N.profile("Xaveir Ronase", ["Amparo Ronase"], {}, known).given == [{"amparo"}]


def test_what_one_work_shows_twice_is_learned_at_any_size(spark):
    data = [(i, f"w{i}", "Amparo Pada", ["安帕罗·帕达"]) for i in range(420)]
    data += [(1000 + i, "w1", "Amparo Ronase", ["安帕罗·罗纳塞", "安帕罗·罗娜塞"]) for i in range(2)]
    lexicon = N.learn(spark.createDataFrame(data, "entry_id bigint, work_id string, canonical string, variants array<string>"), {})
    assert ("纳", "娜") in lexicon.swaps and lexicon.initial["罗"] == "r"


def test_two_slips_link_spellings(spark):
    nodes = spark.createDataFrame([(1, "k", "latin", "famotaz"), (2, "k", "latin", "femotez"), (3, "l", "latin", "famotaz"), (4, "k", "latin", "fumutuz")], "node bigint, block string, script string, word string")
    assert [tuple(r) for r in N.spelling_links(nodes, N.Lexicon()).collect()] == [(1, 2)]
