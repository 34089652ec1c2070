"""Per-text operators: markup, pieces, forms, scans, encodings, tokens, endings."""

import random

import pytest

from tessella.llm import encodings, forms, leakage, markup, pieces, scans, tokens, truncation

tiktoken = pytest.importorskip("tiktoken")


# -- 1 ------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text",
    [
        "带 * 的项目为估算值，编号 #78 的账户除外。", "美元份额的最低金额为 $2300，追加金额为 $50。", "当偏离度 < 3% 且规模 > 24 亿元时无需说明。", "甲方 & 乙方，时间为 9:30~12:00。", "参见附注[24]，文件名含 nav_2010_7。",
        "SELECT fund_code, SUM(amt) FROM nav_1 WHERE unit_class = 'A'", "NAV = (A - L) / 195", "份额  费率\nA类  0.80%", "规模以 10^6 元为单位，占位符 {fund_code} 由系统替换。", "The R&D list, if x < 6 and y > 74.", "", None,
    ],
)
def test_literal_signs_are_no_markup(text):
    assert markup.clean(text)[0] is False


@pytest.mark.parametrize(
    "text, want",
    [
        ("a<b>b</b>c", [("paragraph", 0, "abc")]),
        ("<h2>T</h2><ul><li>x<li>y</ul>", [("heading", 2, "T"), ("list_item", 1, "x"), ("list_item", 1, "y")]),
        ("<table><tr><td>a<td>b</tr></table>", [("table_row", 0, "a\tb")]),
        ("| a | b |\n|---|:--:|\n| 1 | 2 |", [("table_row", 0, "a\tb"), ("table_row", 0, "1\t2")]),
        ("{| class=x\n|-\n| a || b\n|}", [("table_row", 0, "a\tb")]),
        ("\\begin{tabular}{lr}\na & b \\\\\nc & 2\\% \\\\\n\\end{tabular}", [("table_row", 0, "a\tb"), ("table_row", 0, "c\t2%")]),
        ("# T\n\n**b** ~~c~~ [d](u)", [("heading", 1, "T"), ("paragraph", 0, "b c d")]),
        ("== T ==\n\n[[x|y]] {{t|z}}", [("heading", 2, "T"), ("paragraph", 0, "y z")]),
        ("```sql\nSELECT 1\n```\nx", [("code", 0, "SELECT 1"), ("paragraph", 0, "x")]),
        ("\\[R = \\frac{A - L}{3}\\]", [("formula", 0, "R = (A - L) / 3")]),
        ("x&nbsp;y&#12288;z &lt; 3", None),
        ("a<script>q</script>b", [("paragraph", 0, "ab")]),
    ],
)
def test_structure_is_kept(text, want):
    found, got = markup.clean(text)
    assert found and (want is None or got == want)


def test_deep_nesting_does_not_crash():
    found, got = markup.clean("<div>" * 5000 + "x" + "</div>" * 5000)
    assert found and any("x" in b[2] for b in got)


# -- 2 ------------------------------------------------------------------------------------
def test_pieces_cover_overlap_and_stay_within_the_limit():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("甲乙a。，\n ") for _ in range(rng.randint(0, 400)))
        limit = rng.randint(2, 80)
        overlap = rng.randint(0, limit - 1)
        got = pieces.cuts(t, limit, overlap)
        if not t:
            assert got == []
            continue
        assert got[0][0] == 0 and got[-1][1] == len(t) and all(0 < b - a <= limit for a, b in got)
        assert all(q[0] == p[1] - overlap or q[0] == p[0] + 1 for p, q in zip(got, got[1:]))
    with pytest.raises(ValueError, match="overlap"):
        pieces.cuts("abc", 2, 2)


def test_pieces_end_at_sentences_and_by_tokens():
    t = "第一句话在这里。" * 50
    assert all(t[:b].endswith("。") for _, b in pieces.cuts(t, 100, 8))
    sums = pieces.token_sums(t)
    assert sums[-1] == len(tokens.encoder().encode(t))
    assert all(sums[b] - sums[a] <= 64 for a, b in pieces.cuts(t, 64, 5, sums))


# -- 3 ------------------------------------------------------------------------------------
@pytest.mark.parametrize("a, b", [("ＡＢ１，", "AB1,"), ("é", "e\u0301"), ("a\u200bb", "ab"), ("a\u00a0b\u3000c", "a b c"), ("Сосa", "Coca"), ("⻛险⾦", "风险金"), ("a‑b", "a-b"), ("a\r\nb", "a\nb"), ("ё", "ë")])
def test_what_looks_the_same_gets_one_form(a, b):
    assert forms.canonical(a) == forms.canonical(b)
    assert forms.canonical(forms.canonical(a)) == forms.canonical(a)


@pytest.mark.parametrize("a, b", [("1", "2"), ("x²", "x2"), ("①", "1"), ("A", "a"), ("é", "e"), ("國", "国"), ("。", "."), ("、", ","), ("a b", "ab")])
def test_what_looks_different_stays_different(a, b):
    assert forms.canonical(a) != forms.canonical(b)


def test_null_and_plain_text_stay():
    assert forms.canonical(None) is None and forms.canonical("") == "" and forms.canonical("净值abc") == "净值abc"


# -- 4 ------------------------------------------------------------------------------------
def hospital(rng):
    """A text that has nothing of the corpus: its words, its misreadings and its places are of another domain."""
    who = ["值班护士", "主治医师", "住院医生", "社区医院", "门诊登记员"]
    what = ["核对处方剂量", "登记慢性病人", "检查急救药品", "保管麻醉药品", "清点草药柜", "填写手术记录"]
    where = ["重症病房", "传染病区", "精神病院", "内科楼", "外科楼", "儿科楼", "骨科楼", "中药房", "西药房", "中医馆", "军医处"]
    line = lambda: f"{rng.choice(who)}应当在{rng.randint(2, 60)}分钟内到{rng.choice(where)}{rng.choice(what)}，未经科室主任同意不得离开{rng.choice(where)}。"
    return "\n".join("".join(line() for _ in range(rng.randint(2, 4))) for _ in range(3))


MISREAD = dict(zip("医药病科", "匠约柄料"))


def misread(t, rng, share=1.0):
    places = [k for k, c in enumerate(t) if c in MISREAD]
    for k in rng.sample(places, min(len(places), 2)):
        if rng.random() < share:
            t = t[:k] + MISREAD[t[k]] + t[k + 1 :]
    return t


def test_editor_learns_misreadings_of_another_domain():
    rng = random.Random(5)
    corpus = [misread(hospital(rng), rng) if rng.random() < 0.25 else hospital(rng) for _ in range(900)]
    han = scans.learnt(dict(scans.trigram_counts(corpus)))
    assert {c: x[0] for c, x in han.back.items()}.items() >= {b: a for a, b in MISREAD.items()}.items()
    clean = [t for t in corpus if scans.looks_clean(t, han.sure)]
    editor = scans.Editor.train(clean[:300], confusions=han)
    held = [hospital(rng) for _ in range(80)]
    assert sum(sum(editor.edit(t)[1:]) > 0 for t in held) <= 1
    restored = wrapped = 0
    for t in held:
        noisy = misread(t, rng)
        new, chars, _, _ = editor.edit(noisy)
        restored += noisy == t or new == t
        broken = "\n".join(p for x in t.split("\n") for p, _ in scans.wrapped(x, rng, 24))
        wrapped += editor.edit(broken)[2] > 0
    assert restored >= 76 and wrapped >= 76
    assert editor.edit("") == ("", 0, 0, 0)


def test_what_fits_no_neighbour_is_put_right_without_a_list():
    rng = random.Random(6)
    corpus = [hospital(rng) for _ in range(900)]
    editor = scans.Editor.train(corpus[:300], confusions=scans.learnt(dict(scans.trigram_counts(corpus))))
    right = "值班护士应当在30分钟内到重症病房检查急救药品。"
    for wrong in (right.replace("急救药", "急球药"), right.replace("到重症", "到重征")):
        assert editor.edit(wrong)[0] == right
    assert editor.edit(right.replace("检查急救药品", "检查心电图机"))[1] == 0


def test_running_header_without_numbers():
    rng = random.Random(7)
    corpus = [hospital(rng) for _ in range(600)]
    editor = scans.Editor.train(corpus[:300])
    body = [p for t in (hospital(rng), hospital(rng)) for x in t.split("\n") for p, _ in scans.wrapped(x, rng, 24)]
    lines = []
    for k, x in enumerate(body):
        lines.append(x)
        if k % 7 == 4:
            lines.append("医院管理手册")
    new = editor.edit("\n".join(lines))[0]
    assert "医院管理手册" not in new


# -- 6 ------------------------------------------------------------------------------------
def test_wordings():
    w = leakage.wording
    base = "客户在2024年1月21日买入甲乙债券型基金，先后280次共计8807531元。是否可以归档？"
    assert w(base) == w("请问，是否可以归档?客户在2024-01-21买入甲乙债券型基金,先后280次总计8,807,531元。谢谢。")
    assert leakage.same_question(w(base), w(base.replace("归档", "归归档")))
    assert leakage.same_question(w(base), w(base.replace("债券", "券债")))
    for other in (base.replace("280", "281"), base.replace("甲乙", "丙丁"), base.replace("21日", "22日")):
        assert not leakage.same_question(w(base), w(other))


def test_slips_against_brute_force():
    assert leakage.slips("abcd", "abdc", 3) == 1 and leakage.slips("abcd", "abd", 3) == 1 and leakage.slips("abcd", "abccd", 3) == 1
    assert leakage.slips("abcd", "abxd", 3) > 3 and leakage.slips("abcd", "ad", 3) > 3 and leakage.slips("a1", "a", 3) > 3


def test_sentences_are_paired_for_the_fewest_slips():
    swap = lambda t, *at: t if not at else swap(t[: at[0]] + t[at[0] + 1] + t[at[0]] + t[at[0] + 2 :], *at[1:])
    one = "abcdefghijklmnopqrstuvwxyz"
    near = swap(one, 0)
    # The nearest to the first sentence is the one that the second needs.
    a, b = [near, swap(one, 12, 16, 20)], [one, swap(near, 4, 8)]
    assert leakage.same_question("|".join(a), "|".join(b)) and leakage.same_question("|".join(b), "|".join(a))
    assert not leakage.same_question("|".join(a), "|".join([one, swap(near, 4, 8, 14, 18, 22)]))
    assert leakage.slips("aaa", "aaaaaa", 6) == 3


# -- 7 ------------------------------------------------------------------------------------
PLAIN = "基金管理人应当在三十个工作日内对净值公告予以确认，并保留完整的操作痕迹。"


@pytest.mark.parametrize("wrong, written", [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("latin-1", "gb18030"), ("cp1251", "gb18030"), ("koi8_r", "gb18030"), ("gb18030", "utf-8")])
def test_restores_wrong_decoding(wrong, written):
    counts = {ord(c): 1000 for c in PLAIN * 3}
    data = (PLAIN + "。").encode(written)
    try:
        bad = data.decode(wrong)
    except UnicodeDecodeError:
        bad = data.decode(wrong, "replace") if wrong == "gb18030" else "".join(bytes((b,)).decode(wrong) if _ok(b, wrong) else chr(b) for b in data)
    new = encodings.Search(encodings.Plausibility(counts)).restore(bad)
    assert encodings.garbled(bad, new)
    assert new == PLAIN + "。" or (wrong == "gb18030" and PLAIN[:10] in new)


def _ok(b, encoding):
    try:
        bytes((b,)).decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


@pytest.mark.parametrize("text", ["Noëlle Park and Äldermoor, a résumé", "數據接口與資產組合", "Ѕοmе lооkаlіkе lеttеrs", "⾦融⻛险", "Москва", "", "E类份额"])
def test_foreign_letters_stay(text):
    search = encodings.Search(encodings.Plausibility({ord(c): 1000 for c in PLAIN}))
    assert not encodings.garbled(text, search.restore(text))


# -- 8 ------------------------------------------------------------------------------------
def test_ids_equal_two_public_libraries():
    import base64

    e = tokens.encoder()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    alphabets = ["ab", "aeioustrn ", "期的基金一二三，", "0123456789", "é😀ü\u3042", " \n\ta.'s", "\u0001\u00ad\ufffd"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 80))) for _ in range(2000)] + ["a" * 5000, "基" * 5000, "<|endoftext|>"]
    for t in texts:
        assert e.encode(t) == other.encode_ordinary(t)
        assert e.decode(e.encode(t)) == t
    assert e.encode(None) == [] and e.encode("") == []


# -- 10 -----------------------------------------------------------------------------------
def test_censored_fit_recovers_the_distribution():
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.exp(rng.normal(6, 0.7, 20000)).round()
    cut = np.minimum(x, 1000)
    lengths, n = np.unique(cut, return_counts=True)
    mu, sigma = truncation.fit_lognormal(lengths, n, lengths == 1000)
    assert abs(mu - 6) < 0.03 and abs(sigma - 0.7) < 0.03


# -- 1, 3, 7 --------------------------------------------------------------------------------
def test_page_furniture_is_left_out():
    page = """<html><body><div id="menu"><ul><li><a href="/">首页</a></li><li><a href="/a">公告</a></li></ul></div>
<div id="main"><h1>门诊规范</h1><p>值班护士应当在每个工作日对处方进行核对，发现差异的应当立即报告主治医师，并在两个小时内更正。</p>
<h2>第二节</h2><ul><li>第一项：药房应当保存处方不少于二十年。</li><li>第二项</li></ul><pre><code>SELECT a FROM b</code></pre><p>剂量公式 \\(D = A / B\\) 如上，应当由主治医师计算并由药房管理员复核。</p></div>
<div id="side"><p>广告：免费体检</p><p>热线 400</p></div><footer><p>版权所有 2024</p></footer></body></html>"""
    found, blocks = markup.clean(page)
    kinds = [(k, s) for k, _, s in blocks]
    assert found and ("heading", "门诊规范") in kinds and ("list_item", "第二项") in kinds and ("code", "SELECT a FROM b") in kinds and ("formula", "D = A / B") in kinds
    said = markup.plain(blocks)
    assert not any(x in said for x in ("首页", "广告", "热线", "版权"))


def test_markup_has_no_length_limits():
    assert markup.clean('<p class="' + "x" * 600 + '">文字</p>') == (True, [("paragraph", 0, "文字")])
    assert markup.plain(markup.clean("[" + "长" * 250 + "](http://a.b/c)")[1]) == "长" * 250
    deep = "<div>" * 3000 + "<h2>标题</h2><ul><li>甲</li><li>乙</li></ul>" + "</div>" * 3000
    assert [k for k, _, _ in markup.clean(deep)[1]] == ["heading", "list_item", "list_item"]


def test_greek_formulas_stay():
    for t in ("σ=0.5", "α 与 γ", "ν→υ"):
        assert forms.canonical(t) == t


ORIGINAL = "值班护士应当在每个工作日核对处方剂量，发现差异的应当立即报告主治医师。"


@pytest.mark.parametrize("wrong", ["mac_roman", "cp850", "iso8859_5", "cp866", "koi8_r", "cp437", "mac_cyrillic", "iso8859_2", "cp1252"])
def test_many_wrong_readings_are_restored(wrong):
    from collections import Counter

    counts = Counter(ORIGINAL * 50 + "Plain words of a usual text. " * 50)
    search = encodings.Search(encodings.Plausibility({ord(c): n for c, n in counts.items()}))
    lost = ORIGINAL.encode("utf-8").decode(wrong, "replace")
    assert encodings.garbled(lost, search.restore(lost))
    if "\ufffd" not in lost:
        assert search.restore(lost) == ORIGINAL
    twice = ORIGINAL.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    assert search.restore(twice) == ORIGINAL


def test_foreign_texts_are_not_garbled():
    search = encodings.Search(encodings.Plausibility({ord(c): 50 for c in ORIGINAL}))
    for t in ("Это обычный русский текст о больнице.", "한국어 문장입니다", "Ελληνικά κείμενα", "Ça va très bien à Zürich"):
        assert not encodings.garbled(t, search.restore(t))
    assert encodings.codec(" UTF8 ") == "utf-8" and encodings.codec("GB2312") == "gb18030" and encodings.codec("nonsense") is None and encodings.codec(None) is None


def test_evidence_is_fitted():
    table = [(-4.0, "sentence", 800), (-4.0, "structure", 150), (-4.0, "broken", 50), (4.0, "broken", 40), (4.0, "sentence", 2)]
    e = truncation.ending_evidence(table)
    assert e["broken"] > 3 and e["sentence"] < -1 and e["structure"] < -1 and e["marked"] > 1
