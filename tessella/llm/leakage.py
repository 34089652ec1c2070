"""Evaluation questions that also stand in the training split (problem 6).

Texts are brought to one wording (forms, dates, courtesy, synonyms) and reduced to one row
for each distinct wording. Two wordings that ask the same hold the same numbers, so only
wordings whose numbers stand on both sides go on, and they meet shard by shard: a shard
holds whole groups of equal numbers, a group too large for one is cut into a grid of
slices. In a shard an Aho-Corasick automaton made of passages of the evaluation wordings
scans the training wordings; the intervals of an evaluation wording whose passages are met
are merged into its coverage; sufficient coverage makes a candidate, and an exact check
decides: same numbers and dates, sentences in any order, no difference but typing slips.
Wordings of the same numbers that are no candidates so are met by their letters: a slip adds
or drops one letter at most, so nothing that the exact check lets pass is left out.

Passages are overlapping grams, so that a slip breaks only the few it stands in. A wording
is looked for by its rarest grams: by as many as ``SURE`` slips cannot break, where few
wordings share them. What that leaves is left to the letters.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.forms import canonical
from tessella.sources.tables import checkpointed

#: Evaluation and training wordings of one shard at most.
SHARD, BLOCK = 20_000, 100_000
#: Coverage that makes a candidate, slips allowed by the exact check, slips that leave an anchor, wordings of equal numbers that may share an anchor.
COVERAGE, SLIPS, SURE, SHARED = 0.5, 6, 4, 64

# Stems of courtesy. A short clause or sentence that holds one, and no number, title or question, says nothing of the matter.
COURTESY = (
    "(?<![申聘邀提敬])请(?!求)", "您", "你好", "谢", "劳驾", "麻烦", "打扰", "烦", "想问", "想咨询", "想了解", "想确认", "咨询一下", "问一下", "业务问题", "有个问题", "帮忙", "求助", "求教", "感激", "拜托", "辛苦", "答复为盼", "盼复",
    r"\bplease\b", r"\bkindly\b", r"\bhello\b", r"\bhi\b", r"\bdear\b", r"\bthank", r"\bappreciate", r"\bgrateful", r"\bquick question\b", r"\ba question\b", r"\bcould you\b", r"\bcan you\b", r"\bshort answer\b", r"\bin advance\b", r"\badvise\b", r"\bregards\b",
)
# Words and turns that mean the same; the second stands for both.
SYNONYMS = (
    ("可不可以", "是否可以"), ("能不能", "能否"), ("可否", "能否"), ("是不是", "是否"), ("有没有", "有无"), ("要不要", "是否需要"), ("该不该", "是否应当"), ("应不应该", "是否应当"), ("投资人", "投资者"), ("应该", "应当"), ("该如何", "当怎样"), ("如何", "怎样"), ("怎么", "怎样"), ("最晚", "最迟"),
    ("总计", "共计"), ("总共", "共计"), ("合计", "共计"), ("一共", "共计"), ("前述", "上述"), ("准备", "打算"), ("此种情形", "这种情况"), ("这种情形", "这种情况"), ("到现在", "至今"), ("截止", "截至"), ("何时", "什么时候"), ("或是", "或者"),
    ("in this case", "here"), ("noticed", "found"), ("can ", "may "), ("must the ", "should the "), ("with a value of", "worth"), ("altogether", "in total"), ("got ", "received "),
    ("for how long", "how long"), ("bears responsibility", "is responsible"), ("bear responsibility", "is responsible"), ("investors", "holders"),
)
# Months.
MONTHS = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
#: Characters a clause or sentence of courtesy has at most, in Han and in Latin letters.
SHORT_HAN, SHORT_LATIN = 12, 36

_NUMBERS = re.compile(r"(?P<y>\d{4})(?:年(?P<m>\d{1,2})月(?P<d>\d{1,2})日|[-/.](?P<m2>\d{1,2})[-/.](?P<d2>\d{1,2}))|(?P<d3>\d{1,2}) (?P<m3>" + "|".join(MONTHS) + r") (?P<y3>\d{4})|\d[\d,]*(?:\.\d+)?")
_SENTENCE = re.compile(r"([。.?!;…\n]+)(?!\d)|([。?!;…\n]+)")
_CLAUSE = re.compile(r"[,，:：、]")
_NOISE = re.compile(r"[^\w<>]+")
_COURTESY = re.compile("|".join(COURTESY))
_MUST = re.compile("(?<!必)须")
_MEANS = dict(SYNONYMS)
_SYNONYM = re.compile("|".join(rf"\b{re.escape(a)}" if a.isascii() else re.escape(a) for a, _ in sorted(SYNONYMS, key=lambda x: -len(x[0]))))


def _number(m: re.Match) -> str:
    if m["y"]:
        return f"<{int(m['y'])}_{int(m['m'] or m['m2'])}_{int(m['d'] or m['d2'])}>"
    if m["y3"]:
        return f"<{int(m['y3'])}_{MONTHS[m['m3']]}_{int(m['d3'])}>"
    return f"<{m[0].replace(',', '')}>"


def _courtesy(part: str) -> bool:
    """Whether a clause or sentence is nothing but courtesy."""
    size = len(part)
    return size <= SHORT_LATIN and "<" not in part and "《" not in part and (size <= SHORT_HAN or part.isascii()) and _COURTESY.search(part) is not None


def _spoken(sentence: str, mark: str) -> str:
    """A sentence without clauses of courtesy before it; empty if it is courtesy itself."""
    while m := _CLAUSE.search(sentence, 0, SHORT_LATIN + 1):
        head = sentence[: m.start()].strip()
        if head and not _courtesy(head):
            break
        sentence = sentence[m.end() :]
    if "?" not in mark or len(sentence) <= SHORT_HAN or sentence.isascii():
        if _courtesy(sentence.strip()) and not sentence.rstrip().endswith(("吗", "呢", "么")):
            return ""
    return sentence[2:] if sentence.startswith("请问") else sentence


def wording(text: str) -> str:
    """The one wording of a question: its sentences, sorted, joined by '|'; '<...>' marks numbers and dates."""
    t = _NUMBERS.sub(_number, canonical(text).casefold())
    parts = _SENTENCE.split(t)
    found = []
    for k in range(0, len(parts), 3):
        if s := _spoken(parts[k], (parts[k + 1] or parts[k + 2] or "") if k + 2 < len(parts) else ""):
            for _ in range(2):
                s = _SYNONYM.sub(lambda m: _MEANS[m[0]], s)
            if s := _NOISE.sub("", _MUST.sub("需要", s)):
                found.append(s)
    return "|".join(sorted(found))


def apart(a: Counter, b: Counter) -> int:
    """Letters that one of two wordings holds more than the other: as many slips are between them at least, whatever the order of sentences."""
    return sum(abs(a[c] - b[c]) for c in a.keys() | b.keys())


def slips(a: str, b: str, most: int) -> int:
    """Letters dropped, added or swapped with their neighbour between ``a`` and ``b``; more than ``most`` for any other difference.

    A letter replaced by its neighbour counts as two slips. A letter replaced by any other, two
    letters in a row added, or a change in a number is no slip.
    """
    if a == b:
        return 0
    least = apart(Counter(a), Counter(b))
    if abs(len(a) - len(b)) > most or least > most:
        return most + 1  # a slip adds or drops one letter at most
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    k = max(0, k - 1)  # one equal letter stays on either side: a doubled one is known by its neighbour
    c, d = a[k:], b[k:]
    k = 0
    while k < min(len(c), len(d)) and c[-1 - k] == d[-1 - k]:
        k += 1
    k = max(0, k - 1)
    cost = _cost(c[: len(c) - k], d[: len(d) - k], most)
    # Letters that come again and again may take slips where both are equal.
    return cost if cost <= max(1, least) else _cost(a, b, most)


def _cost(a: str, b: str, most: int, closed: tuple[tuple[int, int], ...] = ()) -> int:
    rows = _aligned(a, b, most, False, closed)
    return min(rows[len(a)].get(len(b), (most + 1,))) if rows else most + 1


def _aligned(a: str, b: str, most: int, more: bool = False, closed: tuple[tuple[int, int], ...] = ()) -> list[dict[int, tuple[int, int]]]:
    """Least slips between the beginnings of ``a`` and ``b``, a row for each of ``a``; empty if none is within ``most``.

    The second cost of two is for a letter added or dropped in the last step. ``more``: letters may follow both.
    ``closed``: places that are not passed.
    """
    inf = most + 1
    free = lambda c: not (c.isdigit() or c in "<>_")
    doubled = lambda s, k: (more and k == len(s)) or s[k - 1 : k] in (s[k - 2 : k - 1] if k > 1 else "\0", s[k : k + 1])
    band = most + 1
    rows: list[dict[int, tuple[int, int]]] = [{0: (0, inf)}]
    for i in range(len(a) + 1):
        if i:
            rows.append({})
        for j in range(max(0, i - band), min(len(b), i + band) + 1):
            if i == 0 and j == 0:
                continue
            still, moved = inf, inf
            if i and j and a[i - 1] == b[j - 1] and (p := rows[i - 1].get(j - 1)):
                still = min(p)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2] and free(a[i - 1]) and free(a[i - 2]) and (p := rows[i - 2].get(j - 2)):
                still = min(still, min(p) + 1)
            if i and j and a[i - 1] != b[j - 1] and free(a[i - 1]) and free(b[j - 1]) and (doubled(a, i) or doubled(b, j)) and (p := rows[i - 1].get(j - 1)):
                still = min(still, min(p) + 2)  # one letter dropped, its neighbour doubled
            if i and free(a[i - 1]) and (p := rows[i - 1].get(j)):
                moved = min(moved, p[0] + 1)
            if j and free(b[j - 1]) and (p := rows[i].get(j - 1)):
                moved = min(moved, p[0] + 1)
            if min(still, moved) < inf and (i, j) not in closed:
                rows[i][j] = (still, moved)
        if i and not rows[i] and not rows[i - 1] and not (more and any(j >= len(b) - 1 for row in rows for j in row)):
            return []
    return rows


def _open(a: str, b: str, most: int, closed: tuple[tuple[int, int], ...]) -> int:
    """Slips between two beginnings, whatever follows them; more than ``most`` only if they cannot go on alike."""
    k, size = 0, min(len(a), len(b))
    while k < size and a[k] == b[k]:
        k += 1
    if k == size and not closed:
        return 0
    # Where one ends the other may be ``most`` letters ahead and one swap begun.
    if apart(Counter(a[k:size]), Counter(b[k:size])) > 2 * most + 2:
        return most + 1
    for k in dict.fromkeys((0 if closed else max(0, k - 1), 0)):  # the whole only if not alike without the equal letters before
        x, y = a[k:], b[k:]
        rows = _aligned(x, y, most, True, closed)
        cost = min((min(c) for i, row in enumerate(rows) for j, c in row.items() if i >= len(x) - 1 or j >= len(y) - 1), default=most + 1)
        if cost <= most:
            break
    return cost


_MARKED = re.compile("<[^>]*>")


def numbers(text: str) -> str:
    """The numbers and dates of a wording, sorted: what two wordings of one question share."""
    return "".join(sorted(_MARKED.findall(text)))


def letters(text: str) -> Counter:
    """How often a wording holds each letter."""
    return Counter(text.replace("|", ""))


def _without(sentences: tuple[str, ...], one: str) -> tuple[str, ...]:
    k = sentences.index(one)
    return sentences[:k] + sentences[k + 1 :]


def _woven(x: tuple[str, ...], y: tuple[str, ...], most: int, failed: dict) -> bool:
    """Whether sentences are the same but for their order, slips and lost ends.

    Both sides are put together sentence by sentence, the longest one among them, while one
    can still become the other, the fewest slips first. Where sentences of both end at
    one place the rest is a case of its own, and what goes on does not pass that place.
    ``failed``: the slips with which two rests were tried.
    """
    if not x or not y:
        return not x and not y
    if len(x) == len(y) == 1:
        return slips(x[0], y[0], most) <= most
    if failed.get(key := (x, y), -1) >= most or apart(letters("".join(x)), letters("".join(y))) > most:
        return False
    if max(map(len, x)) < max(map(len, y)):
        x, y = y, x
    first = max(x, key=len)
    starts = [s for s in sorted(set(x), key=len) if s != first] + [first]
    heap, seen = [], set()
    while heap or starts:
        if not heap:
            heap.append((0, 0, _without(x, starts[-1]), y, starts.pop(), "", ()))
        _, _, p, q, a, b, closed = heapq.heappop(heap)
        if a and b and (cost := _cost(a, b, most, closed) if closed else slips(a, b, most)) <= most:
            if p.count(first) < x.count(first) and _woven(p, q, most - cost, failed):
                return True
            if p and q:
                closed = (*closed, (len(a), len(b)))
        steps = [(_without(p, s), q, a + s, b, closed) for s in set(p) if len(a) - len(b) <= most]
        steps += [(p, _without(q, s), a, b + s, closed) for s in set(q) if len(b) - len(a) <= most]
        for step in steps:
            if step not in seen and (cost := _open(step[2], step[3], most, closed)) <= most:
                seen.add(step)
                heapq.heappush(heap, (cost, -min(len(step[2]), len(step[3])), *step))
    failed[key] = most
    return False


def same_question(a: str, b: str, most: int = SLIPS) -> bool:
    """Whether two wordings ask the same question; a sentence that stands in both stands for itself."""
    if a == b:
        return True
    if numbers(a) != numbers(b) or apart(letters(a), letters(b)) > most:
        return False
    left, right = Counter(a.split("|")), Counter(b.split("|"))
    return _woven(tuple(sorted((left - right).elements())), tuple(sorted((right - left).elements())), most, {})


def gram(size: int, ascii_: bool) -> int:
    """Length of the passages cut from a stretch of ``size`` letters: short where the stretch is, or a slip would break all."""
    return max(1, min(size // 3, 8 if ascii_ else 5)) if size > 3 else size


def passages(text: str) -> list[tuple[str, int, int]]:
    """Passages of a wording with their places: numbers whole, and overlapping grams of what stands between them."""
    out = []
    for m in re.finditer(r"<[^>]*>|[^<>|]+", text):
        s, a = m[0], m.start()
        if s[0] == "<":
            out.append((s, a, m.end()))
            continue
        g = gram(len(s), s.isascii())
        out += [(s[k : k + g], a + k, a + k + g) for k in range(len(s) - g + 1)]
    return out


def coverage(parts: list[tuple[str, int, int]], size: int, text: str) -> float:
    """The share of a wording of ``size`` letters that the intervals of its passages met in ``text`` cover, merged."""
    covered, end = 0, 0
    for p, a, b in parts:
        if b > end and p in text:
            covered += b - max(a, end)
            end = b
    return covered / max(1, size)


class Shard:
    """The automaton of evaluation wordings: pairs of a key and a wording. ``times``: how many slices a group of equal numbers was cut into.

    Beside it each group of equal numbers has its wordings by their rarest letters. Of two
    wordings at most ``SLIPS`` letters apart, the rarest letter in both is among the first
    that either has, as far as letters may be missing in the other.
    """

    def __init__(self, wordings: list[tuple[str, str]], times: dict[str, int] | None = None):
        self.text = dict(wordings)
        self.parts = {k: passages(t) for k, t in wordings}
        groups: dict[str, list[str]] = defaultdict(list)
        for k, t in wordings:
            groups[numbers(t)].append(k)
        self.groups = groups
        self.letters: dict[str, Counter] = {}
        self.often: dict[str, Counter] = {}
        self.rarest: dict[str, dict[tuple[str, int], dict[tuple[int, int], list[str]]]] = {}
        automaton = ahocorasick.Automaton()
        anchored: dict[str, dict[str, list[str]]] = {}
        for n, keys in groups.items():
            often = Counter(p for k in keys for p in {q[0] for q in self.parts[k]}) if len(keys) > 1 else {}
            most = SHARED / (times or {}).get(n, 1)
            for k in keys:
                for p in self._anchors(self.parts[k], often, most):
                    anchored.setdefault(p, {}).setdefault(n, []).append(k)
            if len(keys) > SLIPS:
                self.letters.update((k, letters(self.text[k])) for k in keys)
                self.often[n] = Counter(x for k in keys for x in self._each(self.letters[k]))
                self.rarest[n] = {}
                for k in keys:
                    for i, x in enumerate(self._ranked(n, self.letters[k])):
                        self.rarest[n].setdefault(x, {}).setdefault((i, self.letters[k].total()), []).append(k)
        for p, where in anchored.items():
            automaton.add_word(p, where)
        if len(automaton):
            automaton.make_automaton()
        self.automaton = automaton if len(automaton) else None

    @staticmethod
    def _anchors(parts: list[tuple[str, int, int]], often: dict[str, int], most: float) -> list[str]:
        grams = {p: b - a for p, a, b in parts if p[0] != "<"}
        if not grams:
            return [p for p, _, _ in parts[:1]]
        # A slip breaks at most as many passages as one is long, and one more if two letters are swapped.
        broken = max(grams.values()) + 1
        ranked = sorted(grams, key=lambda p: (often.get(p, 1), -len(p), p)) if often else list(grams)
        if not often:  # one wording of its numbers: anchors spread over it
            step = max(1, len(ranked) // (SURE * broken + 1))
            return ranked[::step]
        return [p for p in ranked[: SURE * broken + 1] if often[p] <= most]

    @staticmethod
    def _each(held: Counter) -> list[tuple[str, int]]:
        """Letters, the second of a kind as another one."""
        return [(c, i) for c, k in held.items() for i in range(k)]

    def _ranked(self, n: str, held: Counter) -> list[tuple[str, int]]:
        """The rarest letters among wordings with the numbers ``n``: one more than slips may take."""
        often = self.often[n]
        return heapq.nsmallest(SLIPS + 1, self._each(held), key=lambda x: (often[x], x))

    def _near(self, n: str, text: str, done: set[str]) -> Iterator[str]:
        """Wordings with the numbers ``n`` that are at most ``SLIPS`` letters apart from ``text``, without those ``done``."""
        if len(keys := self.groups.get(n, ())) <= len(done):
            return
        held = letters(text)
        if n not in self.rarest:
            near = set(keys)
        else:
            size, near = held.total(), set()
            for j, x in enumerate(self._ranked(n, held)):
                for (i, other), found in self.rarest[n].get(x, {}).items():
                    if 2 * i <= SLIPS + other - size and 2 * j <= SLIPS + size - other:
                        near.update(found)
            if size <= SLIPS:  # two wordings as short as that may have no letter in common
                near.update(k for k in keys if self.letters[k].total() + size <= SLIPS)
        yield from (k for k in near - done if apart(self.letters.get(k) or letters(self.text[k]), held) <= SLIPS)

    def repeats(self, text: str) -> list[tuple[str, float]]:
        """Evaluation wordings that ``text`` repeats, with their coverage."""
        own, met = numbers(text), set()
        if self.automaton:
            for _, where in self.automaton.iter(text):
                if own in where:
                    met.update(where[own])
        share = {k: coverage(self.parts[k], len(self.text[k]), text) for k in met}
        done = {k for k in met if share[k] >= COVERAGE}
        out = []
        for k in [*done, *self._near(own, text, done)]:
            if (t := self.text[k]) == text:
                out.append((k, 1.0))
            elif same_question(t, text):
                out.append((k, share[k] if k in share else coverage(self.parts[k], len(t), text)))
        return out


def side_of(split: Column) -> Column:
    """A split's name without the blanks around it, in lower case."""
    return F.lower(F.regexp_replace(split, r"^[\s 　]+|[\s 　]+$", ""))


def worded(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text``, with its wording ``w`` and the hash ``n`` of its numbers; rows without a word are left out."""
    kinds = dict(df.dtypes)
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = {t: wording(t) for t in batch[text].unique()}
            w = batch[text].map(known)
            out = batch[keep].assign(w=w, n=w.map({x: numbers(x) for x in set(known.values())}))
            yield out[w != ""]

    return df.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", w string, n string").withColumn("n", F.xxhash64("n"))


def overlap_classes(questions: DataFrame, key: str, text: str, split: str, train: str = "train") -> tuple[DataFrame, DataFrame]:
    """Links between wordings and the members of wordings.

    Links ``ec``, ``tc``, ``coverage``: an evaluation wording and a training wording that
    ask the same. Members ``id``, ``is_train``, ``c``. Links and members together say which
    questions overlap without a row for each pair of copies.

    Defined cases: a null or blank split, a null text and a text without a word belong to
    no link; a key that occurs twice is one question; other columns are ignored.
    """
    side = side_of(F.col(split))
    rows = questions.select(F.col(key).alias("id"), (side == train).alias("is_train"), F.col(text).alias("t")).where(F.col("t").isNotNull() & side.isNotNull() & (side != ""))
    rows = worded(rows, "t").withColumn("c", F.md5("w"))
    rows = checkpointed(rows)
    classes = rows.groupBy("n", "is_train", "c").agg(F.first("w").alias("w"))
    sides = classes.groupBy("n").agg(F.sum((~F.col("is_train")).cast("long")).alias("e"), F.sum(F.col("is_train").cast("long")).alias("t")).where("e > 0 and t > 0")
    sides = checkpointed(sides.select("n", "e", "t", F.ceil(F.col("e") / SHARD).cast("int").alias("es"), F.ceil(F.col("t") / BLOCK).cast("int").alias("ts")))
    total = sides.agg(F.sum("e"), F.sum("t")).first()
    buckets = max(1, -(-(total[0] or 0) // SHARD), -(-(total[1] or 0) // BLOCK), min(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total[0] or 0) // 500))
    d = classes.join(sides, "n")
    slot = lambda k: F.pmod(F.xxhash64("c"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    cell = F.pmod(F.xxhash64("n", "x", "y"), F.lit(buckets)).alias("bucket")
    own = lambda *names: [F.col(x).alias(x) for x in names]
    # The grid of a large group: whole rows of cells for each slice of one side; a group of usual size is one cell.
    e = d.where(~F.col("is_train")).withColumn("x", slot("es")).withColumn("y", every("ts")).select(*own("n", "x", "y", "c", "w", "es"), cell)
    t = d.where("is_train").withColumn("y", slot("ts")).withColumn("x", every("es")).select(*own("n", "x", "y", "c", "w"), cell)

    def scan(e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        # Cells of a large group are scanned one by one, all groups of one cell by one automaton.
        large = (e.es > 1) | (e.y > 0)
        keys = ["n", "x", "y"]
        wide = set(map(tuple, e.loc[large, keys].drop_duplicates().to_numpy().tolist())) | set(map(tuple, t.loc[(t.x > 0) | (t.y > 0), keys].drop_duplicates().to_numpy().tolist()))
        wide_n = {n for n, _, _ in wide}
        for who, es in [(None, e[~e.n.isin(wide_n)])] + [(x, one) for x, one in e[e.n.isin(wide_n)].groupby(keys)]:
            ts = t[~t.n.isin(wide_n)] if who is None else t[(t.n == who[0]) & (t.x == who[1]) & (t.y == who[2])]
            if len(es) and len(ts):
                times = {numbers(es.w.iloc[0]): int(es.es.iloc[0])} if who is not None else None
                shard = Shard(list(zip(es.c, es.w)), times)
                out += [(k, c, share) for c, w in zip(ts.c, ts.w) for k, share in shard.repeats(w)]
        return pd.DataFrame(out, columns=["ec", "tc", "coverage"])

    links = e.groupBy("bucket").cogroup(t.groupBy("bucket")).applyInPandas(scan, "ec string, tc string, coverage double")
    return links, rows.select("id", "is_train", "c").distinct()


def overlaps(questions: DataFrame, key: str, text: str, split: str, train: str = "train") -> DataFrame:
    """Pairs ``eval_id``, ``train_id``, ``coverage``: an evaluation question and a training question that ask the same.

    Every pair of copies of ``overlap_classes`` written out, members of a large wording
    spread over salts; the cases defined there hold.
    """
    links, members = overlap_classes(questions, key, text, split, train)
    links = checkpointed(links)
    # A wording with many members would put all its pairs into one task: its evaluation members are dealt over salts of its training members.
    counts = members.groupBy("is_train", "c").agg(F.ceil(F.count("*") / 1000).cast("int").alias("salts"))
    t = members.where("is_train").join(counts.where("is_train").select("c", "salts"), "c").select(F.col("id").alias("train_id"), F.col("c").alias("tc"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    e = members.where(~F.col("is_train")).select(F.col("id").alias("eval_id"), F.col("c").alias("ec"))
    wide = links.join(counts.where("is_train").select(F.col("c").alias("tc"), "salts"), "tc").select("ec", "tc", "coverage", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return wide.join(e, "ec").join(t, ["tc", "salt"]).where("eval_id <> train_id").select("eval_id", "train_id", "coverage")
