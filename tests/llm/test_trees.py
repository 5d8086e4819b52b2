"""Manifests, repair of conversations and license scans against sequential versions."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from logweft.llm import licenses, merkle, queries, repair


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 ---

def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root over some digests, and each one's proof as (left, right) a level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf_no, i in enumerate(at):
            run = i // 3 * 3
            steps[leaf_no].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes, at = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], steps


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, steps) of (doc_id, source, text) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found, tops = [], []
    for g in names:
        mine = sorted(((r, leaf(r)) for r in groups[g]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        top, steps = climb([d for _, d in mine])
        tops.append(top)
        found.append((mine, steps))
    root, over = climb(tops)
    return sorted(((r[0], d, top, root, tuple(s + up)) for (mine, steps), top, up in zip(found, tops, over) for (r, d), s in zip(mine, steps)), key=repr)


def built(df, spark):
    leaves = df.withColumn("leaf", merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("text")))
    m = merkle.manifest(leaves, F.col("source"), ["doc_id"], ["doc_id", "text"])
    got = m.rows.select("doc_id", *(merkle.hexed(F.col(c)) for c in ("leaf", "subroot", "root")), F.transform("steps", lambda s: F.struct(merkle.hexed(s["left"]), merkle.hexed(s["right"])))).collect()
    assert m.rows.where(merkle.fold(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0
    return sorted(((r[0], r[1], r[2], r[3], tuple(tuple(s) for s in r[4])) for r in got), key=repr), m


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 40, None: 1, "": 3, "é": 4, "b": 9}, {"hot": 250, "x": 2, "y": 28}])
def test_manifest_against_sequential(spark, sizes):
    r = random.Random(len(sizes))
    rows = [(i * 7 % 400 + 1000 * k, g, r.choice([None, "", "t\n", "é" * 5]) or "") for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(None, "a", None), (None, "a", "z"), (rows[0]), (rows[0])] if len(sizes) > 1 else []
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").select("*", F.lit(1).alias("place"), F.lit("t").alias("tree"), F.lit(2).alias("of"), F.lit(3).alias("digest"), F.lit(4).alias("kept")).repartition(7)
    assert built(df, spark)[0] == brute_manifest(rows)


def test_changed_rows_do_not_fold_to_the_root(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}", f"text {i}") for i in range(100)], "doc_id long, source string, text string")
    _, m = built(df, spark)
    other = m.rows.withColumn("leaf", F.when(F.col("doc_id") % 9 == 0, merkle.hashed(F.lit("no"))).otherwise(F.col("leaf")))
    bad = other.where(merkle.fold(F.col("leaf"), F.col("steps")) != F.col("root")).select("doc_id").collect()
    assert sorted(r[0] for r in bad) == list(range(0, 100, 9))
    assert [r["group"] for r in m.subroots.orderBy("place").collect()] == ["s0", "s1", "s2", "s3"]


def test_empty_manifest(spark, empty):
    got, m = built(empty, spark)
    assert got == [] and m.subroots.count() == 0


# --- 12 ---

def brute_repair(turns):
    """Faults and cheapest edits of one conversation by trying all states turn by turn; turns are (turn, role, text) in order."""
    counts, seen, marks = dict.fromkeys(repair.FAULTS, 0), set(), []
    for _, role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append(fault)
        if fault:
            counts[fault] += 1
    follow = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def inserted(states):
        for _ in range(2):
            for last, (cost, audit, out) in list(states.items()):
                for r in "ua":
                    if (last, r) in follow:
                        new = (cost + 3, audit + "I", (*out, ({"u": "user", "a": "assistant"}[r], "")))
                        states[r] = min(states.get(r, new), new)
        return states

    states = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(turns, marks):
        nxt = {}
        for last, (cost, audit, out) in states.items():
            ways = [(last, cost + 4, audit + "D", out)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if (last, role[:1]) in follow:
                    ways.append((role[:1], cost + more, audit + "K", (*out, (role, text))))
                ways += [(r, cost + 3 + more, audit + "R", (*out, (name, text))) for r, name in (("u", "user"), ("a", "assistant")) if (last, r) in follow]
            for s, *v in ways:
                nxt[s] = min(nxt.get(s, tuple(v)), tuple(v))
        states = inserted(nxt)
    cost, audit, out = min(states[s] for s in ("", "a") if s in states)
    numbers = [t for t, *_ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (gaps, *counts.values(), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))


def ordered(turns):
    return sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))


def repaired(df):
    done = repair.repair(df)
    found = done.report.join(repair.digests(done.turns), "conv", "left").collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha256 or sha("")) for r in found}, done


TEXTS = ["Yes.", "No!", "cut off", "", " \n\t", "Why?\n ", "é", "Ok. "]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", ""]


def test_repair_against_sequential(spark):
    r = random.Random(4)
    convs = {c: [(r.choice([None, *range(9)]), r.choice(ROLES), r.choice(TEXTS) + (str(k) + "." if r.random() < 0.7 else "")) for k in range(r.choice([1, 2, 5, 9]))] for c in [None, *range(60)]}
    rows = [(c, t, role, text) for c, turns in convs.items() for t, role, text in turns]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit(9).alias(c) for c in ("conv", "place", "of", "fault", "letter", "edit", "step", "said"))).repartition(6)
    got, _ = repaired(df)
    assert got == {c: brute_repair(ordered(turns)) for c, turns in convs.items()}


def test_long_conversation_over_many_pieces(spark, monkeypatch):
    r = random.Random(8)
    turns = [(k // 2, r.choice(ROLES[:5]), f"{r.randint(0, 2500)}{r.choice(['.', '', '!'])}" if r.random() < 0.95 else "") for k in range(3000)]
    rows = [(1, *t) for t in turns] + [(2, 0, "user", "Hi.")]
    monkeypatch.setattr(repair, "PIECE_BITS", 4)
    monkeypatch.setattr(repair, "ROUND_BITS", 2)
    got, done = repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9))
    assert got == {1: brute_repair(ordered(turns)), 2: brute_repair([(0, "user", "Hi.")])}
    roles = "".join(x.role[0] for x in done.turns.where("conv_id = 1").orderBy("step").collect())
    assert roles.removeprefix("s") == "ua" * (len(roles) // 2)


def test_products_are_associative():
    r = random.Random(2)
    for _ in range(200):
        letters = "".join(r.choice(repair.PLAIN + repair.CUT + repair.GONE) for _ in range(r.randint(2, 9)))
        cut = sorted(r.sample(range(1, len(letters)), min(2, len(letters) - 1)))
        parts = [letters[a:b] for a, b in zip([0, *cut], [*cut, len(letters)])]
        pieces = [repair.read_piece(repair.piece_of(p)) for p in parts]
        assert repair.joined(pieces) == repair.read_piece(repair.piece_of(letters))
        if len(pieces) == 3:
            assert repair.joined([pieces[0], repair.joined(pieces[1:])]) == repair.joined([repair.joined(pieces[:2]), pieces[2]])


def test_cheapest_edits_against_every_audit():
    """All audits of up to three turns and two insertions, tried one by one."""
    for letters in map("".join, itertools.product("suaxUA0", repeat=2)):
        fits = []
        for n in range(0, 5):
            for audit in itertools.product("DIKR", repeat=n):
                if sum(e != "I" for e in audit) != len(letters):
                    continue
                at, options, cost = 0, [""], 0
                for e in audit:
                    c = None if e == "I" else letters[at]
                    at += e != "I"
                    if e != "D" and c == "0" or e == "K" and c == "x":
                        options = []
                    cost += {"D": 4, "I": 3, "K": 0, "R": 3}[e] + (3 if e in "KR" and c in ("U", "A") else 0)
                    if e != "D":
                        options = [o + x for o in options for x in (c.lower() if e == "K" else "ua")]
                if any(o.removeprefix("s") == "ua" * (len(o) // 2) and o != "s" for o in options):
                    fits.append((cost, "".join(audit)))
        assert repair.best(repair.read_piece(repair.piece_of(letters))) == min(fits), letters


def test_damage_and_empty_conversations(spark, tmp_path):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repaired(none)[0] == {} and queries.damaged(none).count() == 0
    import zlib

    rows = [(c, t, "user", "A. b! c?") for c in range(40) for t in range(2)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    fate = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    assert set(got) == {c for c, *_ in rows}
    for c, r in got.items():
        left = []
        for t in (None,) if c is None else (0, 1):
            f, role, text = fate(c, t), "user" if c is not None else " ", "A. b! c?" if c is not None else " "
            if f:
                left += [(t, "user" if f == 4 else role, "" if f == 1 else "A b c" if f == 2 and c is not None else text)] * (2 if f == 3 else 1)
        want = brute_repair(ordered(left)) if left else (0, 0, 0, 0, 0, 0, "", sha(""))
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want


# --- 13 ---

def brute_spans(text):
    """Diagonals of one text, in plain loops."""
    words = licenses.words_of(text or "")
    out = []
    for t in licenses.PHRASES + licenses.NOTICES:
        tw = licenses.words_of(t.text)
        k = licenses.LONG if len(tw) >= licenses.LONG else licenses.SHORT
        spots = {}
        for i in range(len(words) - k + 1):
            for j in range(len(tw) - k + 1):
                if words[i : i + k] == tw[j : j + k]:
                    spots.setdefault(i - j, set()).update(range(j, j + k))
        lines = sorted((d + min(c), d, d + max(c) + 1, c) for d, c in spots.items())
        places = []
        for begin, d, end, cover in lines:
            if places and not t.phrase and begin <= places[-1][1] + licenses.GAP and abs(d - places[-1][2]) <= licenses.SHIFT:
                p = places[-1]
                places[-1] = (p[0], max(p[1], end), d, p[3] | cover)
            else:
                places.append((begin, end, d, set(cover)))
        out += [(b, e, t.label, t.phrase, len(c) / len(tw)) for b, e, _, c in places if len(c) >= len(tw) * (1 if t.phrase else licenses.LEAST_COVER)]
    return len(words), sorted(set(out))


def license_texts():
    r = random.Random(3)
    texts = [None, "", "mit", "MIT License", "cc by cc by-nc CC.BY", "gnu general public gnu general public license license", "apache éLicense Apache\x00License", "word " * 30_000 + "mit license " * 300]
    for t in licenses.PHRASES + licenses.NOTICES:
        words = t.text.split()
        for _ in range(4):
            w = list(words)
            for _ in range(r.randint(0, max(0, len(w) // 8))):
                i = r.randrange(len(w))
                w[i : i + r.choice([0, 1, 2])] = r.choice([[], ["x"], ["more", "words"]])
            texts.append(" ".join(["lorem", "of", "the"] * r.randint(0, 9) + w + ["end"] + words[: len(words) // 3]))
    return texts + texts[3:6]


def test_license_spans_against_loops(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(license_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("row", "words", "hash", "template", "label", "at", "spans"))).repartition(5)
    got = sorted(((r.doc_id, r.n_words, [(s.start, s.end, s.label, s.phrase, s.cover) for s in r.spans]) for r in licenses.scan(df).collect()), key=repr)
    assert got == sorted(((i, *brute_spans(t)) for i, t in rows), key=repr)


def test_each_notice_is_found_with_changed_words(spark):
    texts = [(k, "before " * 20 + " ".join(w for i, w in enumerate(t.text.split()) if len(t.text.split()) < 20 or i % 12 != 11) + " after" * 20) for k, t in enumerate(licenses.NOTICES)]
    for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        assert licenses.NOTICES[r.doc_id].label in {s.label for s in r.spans}, r


def test_license_templates_and_empty_tables(spark, empty):
    assert licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(empty, [licenses.Template("x", "word")])
    own = [licenses.Template("own", "one two three", True)]
    got = licenses.scan(spark.createDataFrame([(1, "one two three one two one two three")], "doc_id long, text string"), own).first()
    assert [(s.start, s.end, s.label) for s in got.spans] == [(0, 3, "own"), (5, 8, "own")]
