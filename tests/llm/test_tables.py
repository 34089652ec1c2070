"""The operators over tables: nulls, empty tables, repeats, ties, long texts, clashing columns."""

import pytest

from tessella.llm import encodings, forms, leakage, markup, packing, pieces, scans, tokens, truncation


def frame(spark, rows, columns="k string, t string"):
    return spark.createDataFrame(rows, columns)


LONG = "基金管理人应当披露净值公告。" * 20_000
ROWS = [("a", None), ("b", ""), ("c", " "), ("d", "x" * 10), ("d", "x" * 10), ("e", LONG), (None, "y")]

OPERATORS = {
    "markup": lambda d: markup.cleaned(d, ["k"], "t"),
    "pieces": lambda d: pieces.split(d, ["k"], "t", 600, 60),
    "scans": lambda d: scans.repaired(d, ["k"], "t"),
    "encodings": lambda d: encodings.restored(d, ["k"], "t"),
    "tokens": lambda d: tokens.encode_texts(d, "k", "t"),
    "truncation": lambda d: truncation.cut_texts(d.selectExpr("k", "t", "'s' as s"), "k", "t", "s"),
    "forms": lambda d: forms.lookalikes(d.selectExpr("k", "t", "'g' as g"), "k", "t", "g"),
    "packing": lambda d: packing.pack(tokens.count_tokens(d, "k", "t"), "k", "size", 100),
    "leakage": lambda d: leakage.overlaps(d.selectExpr("k", "t", "'train' as s"), "k", "t", "s"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    OPERATORS[name](frame(spark, ROWS)).collect()
    assert OPERATORS[name](frame(spark, [])).count() == 0


def test_extra_columns_with_clashing_names_do_not_matter(spark):
    d = frame(spark, [("a", "<b>x</b>", "1", "2", "3")], "k string, t string, blocks string, ids string, size string")
    assert markup.cleaned(d, ["k"], "t").first().clean_text == "x"
    assert tokens.encode_texts(d, "k", "t").first().ids == tokens.encoder().encode("<b>x</b>")
    assert pieces.split(d, ["k"], "t", 5, 1).count() == 2


def test_ids_of_null_and_empty_texts_and_repeats(spark):
    got = sorted((r.k or "", r.ids) for r in tokens.encode_texts(frame(spark, ROWS[:5]), "k", "t").collect())
    assert got[0] == ("a", []) and got[1] == ("b", []) and got[3] == got[4]


def test_lookalike_pairs_are_all_and_only_differing_records(spark):
    rows = [("a", "Fund Ａ"), ("b", "Fund A"), ("c", "Fund A"), ("d", "Fund\u00a0A"), ("e", "Fund B"), ("a", "Fund Ａ"), ("f", None), ("g", "")]
    got = {(r.id_a, r.id_b) for r in forms.lookalikes(frame(spark, rows).selectExpr("k", "t", "'x' as g"), "k", "t", "g").collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("c", "d")}


def test_packing_keeps_every_item_whole_and_within_capacity(spark):
    import random

    rng = random.Random(6)
    sizes = [(i, rng.choice([0, 5, 30, 60, 99, 100, 101, 350]) if i % 7 else rng.randint(0, 100)) for i in range(900)] + [(3, None)]
    got = packing.pack(spark.createDataFrame(sizes, "id long, size int"), "id", "size", 100, group=300).collect()
    bins, parts = {}, {}
    for r in got:
        bins.setdefault(r.container, []).append(r.part_size)
        parts.setdefault(r.id, []).append(r.part_size)
    assert all(sum(b) <= 100 for b in bins.values())
    for i, n in sizes[:900]:
        if i != 3:
            assert sum(parts[i]) == n and len(parts[i]) == max(1, -(-n // 100))
    total = sum(n or 0 for _, n in sizes)
    assert len(bins) <= 1.04 * total / 100 + 3


def test_evolution_never_gets_worse():
    import random

    rng = random.Random(1)
    sizes = [rng.randint(10, 70) for _ in range(300)]
    first = packing.best_fit(list(range(300)), sizes, 100, [])
    people = packing.evolve(sizes, 100, [first], rng)
    assert len(people) == packing.POPULATION
    for p in people:
        assert sorted(i for b in p for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 100 for b in p)
    assert len(people[0]) <= len(first)
    again = packing.evolve(sizes, 100, people, rng)
    assert packing.fitness(again[0], sizes, 100) >= packing.fitness(people[0], sizes, 100)


def test_overlaps_find_repeats_and_not_other_questions(spark):
    q = "截至2010年10月19日，甲乙基金已连续385个工作日规模低于3179326元。是否需要披露？"
    rows = [("t1", q, " Train"), ("e1", "请问，" + q, "dev\t"), ("e2", q.replace("385", "386"), "test"), ("e3", q.replace("披露", "披披露"), "Holdout"), ("n", None, "dev"), ("m", q, None), ("t1", q, " Train")]
    got = {(r.eval_id, r.train_id) for r in leakage.overlaps(spark.createDataFrame(rows, "k string, t string, s string"), "k", "t", "s").collect()}
    assert got == {("e1", "t1"), ("e3", "t1")}


def test_cut_texts_and_their_copies(spark):
    import random

    rng = random.Random(8)
    line = lambda: f"第{rng.randint(1, 99)}次会议审议了修订稿，期限改为{rng.randint(2, 60)}个工作日。"
    full = ["".join(line() for _ in range(rng.randint(2, 30))) for _ in range(300)]
    rows = [(str(i), t[:400], "limited") for i, t in enumerate(full)] + [("copy", next(t for t in full if len(t) > 420 and t[399] not in "。")[:400], "other")]
    rows += [("w1", full[0][:30] + "。", "other"), ("w2", "净值公告\n2020年1月1日", "other"), ("w3", None, "other"), ("w4", " ", "other"), ("m", full[0][:40] + "…", "other")]
    cut = {r.k for r in truncation.cut_texts(spark.createDataFrame(rows, "k string, t string, s string"), "k", "t", "s").where("cut").collect()}
    want = {str(i) for i, t in enumerate(full) if len(t) > 400 and t[399] != "。"}
    assert want <= cut and not {"w1", "w2", "w3", "w4"} & cut and {"copy", "m"} <= cut
    assert all(len(full[int(k)]) >= 400 for k in cut if k.isdigit())


def test_editor_knows_words_outside_its_sample(spark):
    texts = ["基金管理人应当于每个交易日披露净值公告，不得延期，并保存记录以备账户持有人查阅，编号为%d。" % i for i in range(60)]
    texts += [f"The figures of this quarter stand in annex {i} and were confirmed by the trustee." for i in range(200)]
    texts += [f"The figurcs of this quarter stand in annex {i} and were confirmed by the trustee." for i in range(3)]
    df = frame(spark, [(str(i), t) for i, t in enumerate(texts)])
    words = scans.trained(df, "t", sample=10).words
    assert {"figures", "quarter", "trustee"} <= words and "figurcs" not in words
    counts = {r.w: r.n for r in scans.word_counts(df.unionByName(df), "t", frozenset()).collect()}
    assert counts["figures"] == 200 and counts["quarter"] == 203


def test_repeats_without_numbers_and_with_slips(spark):
    a, b = "基金管理人可以拒绝投资者的赎回申请吗？", "Which fees may the custodian charge to the holders of the fund?"
    rows = [("t1", a, "train"), ("t2", b, "train"), ("e1", a.replace("的", "的的"), "dev"), ("e2", "劳驾，" + a, "dev"), ("e3", b.replace("the", "teh", 1).replace("holders", "hodlers"), "test"), ("e4", a.replace("赎回", "申购"), "test"), ("e5", b.replace("custodian", "manager"), "test")]
    got = {(r.eval_id, r.train_id) for r in leakage.overlaps(spark.createDataFrame(rows, "k string, t string, s string"), "k", "t", "s").collect()}
    assert got == {("e1", "t1"), ("e2", "t1"), ("e3", "t2")}


def test_repeats_do_not_depend_on_shards(spark, monkeypatch):
    import random

    rng = random.Random(2)
    fact = lambda: f"{''.join(rng.choice('甲乙丙丁戊己庚辛壬癸') for _ in range(5))}医院在第12周登记住院病人，值班护士应当怎样核对处方剂量？"
    base = [fact() for _ in range(40)]
    rows = [(f"t{i}", x, "train") for i, x in enumerate(base)] + [(f"e{i}", x.replace("登记", "登登记") if i % 2 else x.replace("剂量", "量剂"), "dev") for i, x in enumerate(base)]
    df = spark.createDataFrame(rows, "k string, t string, s string")
    found = lambda: {(r.eval_id, r.train_id) for r in leakage.overlaps(df, "k", "t", "s").collect()}
    whole = found()
    assert whole >= {(f"e{i}", f"t{i}") for i in range(40)}
    monkeypatch.setattr(leakage, "SHARD", 7)
    monkeypatch.setattr(leakage, "BLOCK", 9)
    assert found() == whole


def test_no_repeat_is_left_out_among_many_of_its_numbers():
    import random

    rng = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(300)]
    say = lambda k: "".join(rng.choice(letters) for _ in range(k))
    names = [say(4) for _ in range(150)]
    base = [leakage.wording(f"{x}医院值班护士应当怎样核对处方剂量？") for x in names] + [leakage.wording(say(6)) for _ in range(20)]

    def slip(t, k):
        for i in sorted(rng.sample(range(0, len(t) - 1, 2), min(k, len(t) // 2 - 1)), reverse=True):
            t = t[:i] + t[i + 1] + t[i] + t[i + 2 :]
        return t

    other = [slip(t, rng.randint(0, leakage.SLIPS)) for t in base]
    shard = leakage.Shard([(str(i), t) for i, t in enumerate(base)])
    got = {(k, t) for t in other for k, _ in shard.repeats(t)}
    assert got == {(str(i), t) for i, e in enumerate(base) for t in other if leakage.same_question(e, t)}
    assert {(str(i), t) for i, t in enumerate(other)} <= got


def test_lost_sentence_ends_in_any_order(spark):
    a, b, c = "住院病人在周末办理出院手续", "值班护士应当怎样核对处方剂量", "门诊登记员可以拒绝退药吗"
    rows = [("t1", f"{b}？{a}。{c}？", "train"), ("e1", f"{b}{a}。{c}？", "dev"), ("e2", f"{c}{b}{a}", "dev"), ("e3", f"{b}？{a}{c}？", "dev"), ("e4", f"{c}？{a}{b}核？", "dev"), ("e5", f"{b}{a}。{c.replace('退药', '换药')}？", "dev")]
    rows += [("t2", f"{b}？{a}{c}？", "train")]
    got = {(r.eval_id, r.train_id) for r in leakage.overlaps(spark.createDataFrame(rows, "k string, t string, s string"), "k", "t", "s").collect()}
    assert got == {(e, "t1") for e in ("e1", "e2", "e3", "e4")} | {("e1", "t2"), ("e3", "t2")}


def test_overlap_classes_say_links_without_pairs_of_copies(spark):
    q = "截至2010年10月19日，甲乙基金已连续385个工作日规模低于3179326元。是否需要披露？"
    rows = [(f"t{i}", q, "train") for i in range(30)] + [(f"e{i}", q, "dev") for i in range(20)]
    links, members = leakage.overlap_classes(spark.createDataFrame(rows, "k string, t string, s string"), "k", "t", "s")
    assert links.count() == 1 and members.count() == 50


def test_cut_endings_of_long_texts(spark):
    from pyspark.sql import functions as F

    texts = {
        "sentence": "基金管理人应当报告。" + " " * 2500, "structure": "正文。\n（" + "注" * 2500 + "）", "broken": "基金管理人应当在" + "很" * 3000 + "报",
    }
    df = spark.createDataFrame(list(texts.items()), "want string, t string")
    assert all(r.want == r.got for r in df.select("want", truncation.ending(F.col("t")).alias("got")).collect())
    row = "| " + "甲" * 2500 + " | 乙 |"
    assert spark.createDataFrame([(row,)], "t string").select(truncation.ending(F.col("t")).alias("k")).first().k == "structure"


def test_once_keeps_one_row_of_a_key(spark):
    from tessella.llm.queries import once

    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "z")], "k string, t string")
    assert sorted(map(tuple, once(df, "k").collect()), key=str) == sorted([("a", "x"), ("b", "y"), (None, "z")], key=str)


def test_form_classes(spark):
    df = spark.createDataFrame([("t", "1", "净值ａ"), ("t", "2", "净值a"), ("t", "3", "净值a"), ("t", "4", "别的")], "g string, k string, t string")
    got = forms.form_classes(forms.form_members(df, "k", "t", "g")).collect()
    assert [(r.n_spellings, r.n_records) for r in got] == [(2, 3)]
    pairs = {(r.id_a, r.id_b) for r in forms.lookalikes(df, "k", "t", "g", salted=1).collect()}
    assert pairs == {("1", "2"), ("1", "3")}
