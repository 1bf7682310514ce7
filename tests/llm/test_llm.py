import math
import os
import random
import time

import pytest

pytest.importorskip("pothika.llm.queries")
from pothika.llm import boilerplate, components, encoding, garbled, language, leaks, linkage, lookalikes, nearcopies, scanned  # noqa: E402
from pothika.llm.agreement import matched  # noqa: E402


def test_garbled_round_trip():
    right = "प्रभु दर्शन – मन भावे ॥ ૧૨ ॥ sībāṇa"
    for wrong in ("latin-1", "cp1252", "cp1251", "mac-roman", "cp437"):
        bad = "".join(garbled._read(c.encode(), wrong) for c in right)
        fixed, runs, lost = garbled.repair("साफ पाठ é “” " + bad)
        assert runs >= 1 and not lost
        assert fixed == "साफ पाठ é “” " + right
    assert garbled.repair("déjà “उद्धरण” © जीवन") == ("déjà “उद्धरण” © जीवन", 0, 0)
    assert garbled.repair("सज्झ��य")[2] == 2


def test_garbled_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "à¤•à¤¥à¤¾", "x"), (3, "à¤•à¤¥à¤¾", "x"), (4, "कथा", "x")], "id bigint, t string, runs string")
    assert [tuple(r) for r in garbled.repaired(df, "id", "t").collect()] == [(3, "कथा", 1, 0)] * 2
    assert garbled.repaired(df.limit(0), "id", "t").count() == 0


def test_components_follow_brute_force(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, None), (None, None), (7, 7)]
    pairs += pairs[:9]
    root = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if None not in (a, b) and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "l bigint, r bigint")
    assert {(r.group_no, r.node) for r in components.connected_groups(df, "l", "r").collect()} == {(find(x), x) for x in root}
    assert components.connected_groups(df.limit(0), "l", "r").count() == 0


def test_boilerplate(spark):
    rows = [(i, "L", f"b{i % 4}", f"Share THIS {i}!\nपाठ {'कखगघचछजझ'[i % 8]}{'टठडढ'[i % 4]}{i}") for i in range(40)] + [(99, "L", "b0", None), (98, None, None, "x")]
    df = spark.createDataFrame(rows, "id int, lib string, book string, text string")
    got = boilerplate.repeated_lines(df, "id", "lib", "book", "text", share=0.5)
    assert {(r.id, r.line_no) for r in got.collect()} == {(i, 1) for i in range(40)}
    clean = boilerplate.without_lines(df, "text", "lib", boilerplate.frequent_lines(df, "lib", "book", "text", share=0.5))
    assert {r.id: r.text for r in clean.collect()}[99] is None and clean.filter("removed = 1").count() == 40


def test_lookalikes(spark):
    cases = {"प्रभु नुં": 1, "जी​": 1, "थोड़ो": 1, "थोड़ो": 0, "रास ||१||": 1, "रास ॥१॥, (2)": 0, "Rajіye": 1, "Sībāṇa": 0, "अारती": 1, "थोडी़": 1, "થોડી઼": 1, "थोड़ी": 0, "": 0, "a  b": 0}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(50, None)], "id bigint, title string")
    found = {r.id for r in lookalikes.lookalike_fields(df, "id", ["title"]).collect()}
    assert found == {i for i, v in enumerate(cases.values()) if v}


@pytest.fixture(scope="module")
def encoder():
    return encoding.PrefixEncoder(encoding.vocabulary_path())


def test_encoding_follows_the_tokenizer(spark, encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encoding.vocabulary_path())
    t.encode_special_tokens = True
    texts = ["", None, "the library's old books", "प्रभु  दर्शन\n\n<|endoftext|>", "a" * 300, " ​ x" * 40]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string")
    for i, ids in encoding.encoded(df, "doc_id", "text").collect():
        assert ids == (t.encode(texts[i], add_special_tokens=False).ids if texts[i] else [])


def test_edits_of_a_piece(encoder):
    rnd = random.Random(2)
    piece = encoding.EditablePiece(encoder, b"remembering" * 30)
    for _ in range(20):
        a = rnd.randrange(len(piece.data))
        piece.replace(a, min(len(piece.data), a + rnd.randrange(3)), rnd.choice([b"", b"th", b"ing"]))
        piece.append(b"er")
        assert piece.ids() == encoder.encode_piece(piece.data)


def test_leaks(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}rd" for i in range(200)]
    items = spark.createDataFrame([(1, " ".join(words[:40])), (2, " ".join(words[100:130])), (3, None), (4, "")], "item bigint, text string")
    docs = [(1, " ".join(["zz"] * 30 + words[10:24] + ["yy"] * 30)), (2, "1. " + " ".join(words[100:130]).upper() + "!"), (3, " ".join(words[:5])), (4, None), (5, "")]
    bad = words[5:25]
    bad[9] = bad[9] + "x"
    df = spark.createDataFrame(docs + [(6, " ".join(bad))], "doc bigint, text string")
    got = leaks.leaks(items.withColumnRenamed("item", "item_id"), "item_id", df, "doc")
    assert {(r.item_id, r.doc) for r in got.collect()} == {(1, 1), (2, 2), (1, 6)}
    assert leaks.leaks(items.withColumnRenamed("item", "item_id"), "item_id", df.limit(0), "doc").count() == 0


def test_near_copies_and_linkage(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("कगजतदपमरलवसह") + rnd.choice("ािीुेो") for _ in range(rnd.randint(2, 4)))
    texts = [([word() for _ in range(12)], [word() for _ in range(12)]) for _ in range(20)]
    rows = [(i, " ".join(a), " ".join(b), "x") for i, (a, b) in enumerate(texts)]
    rows += [(100 + i, " ".join(a[6:] + a[:6]), " ".join(b[:-1]) + " ॥१॥", "x") for i, (a, b) in enumerate(texts)] + [(200, rows[0][1], rows[0][2], "x"), (201, None, "क", "x"), (202, "", "", "x")]
    df = spark.createDataFrame(rows, "id bigint, aadi string, ant string, cls string")
    pairs = {(r.a, r.b) for r in nearcopies.near_copy_pairs(df, "id", "aadi", "ant").collect()}
    assert pairs == {(i, 100 + i) for i in range(20)} | {(0, 200), (100, 200)}
    catalog = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(texts)] + [(50, " ".join(texts[0][0]), " ".join(texts[1][1])), (51, None, None)], "pos bigint, opening string, closing string")
    links = {(r.pos, r.id) for r in linkage.linked(catalog, "pos", ("opening", "closing"), df, "id", ("aadi", "ant")).collect()}
    assert links == {(i, i) for i in range(20)} | {(i, 100 + i) for i in range(20)} | {(0, 200)}
    assert matched(("कखग", "चछज"), ("चछज", "कखघ")) == (5, 2)


def test_linkage_keeps_all_variants_of_a_hot_entry(spark):
    rnd = random.Random(6)
    words = list(dict.fromkeys("".join(rnd.choice("कगजतदपमरलवसह") + rnd.choice("ािुेो") for _ in range(5)) for _ in range(700)))
    opening, closing = " ".join(words[:12]), " ".join(words[12:42])
    # one variant has the closing too, which the entry shares with no other
    works = [(0, opening, closing)] + [(i, f"{opening} {words[41 + i]}", None) for i in range(1, 501)]
    df = spark.createDataFrame(works, "id bigint, aadi string, ant string")
    catalog = spark.createDataFrame([(7, opening, closing)], "pos bigint, opening string, closing string")
    got = linkage.linked(catalog, "pos", ("opening", "closing"), df, "id", ("aadi", "ant"))
    assert {(r.pos, r.id) for r in got.collect()} == {(7, i) for i in range(501)}


def test_what_cannot_agree_is_given_up_without_loss():
    rnd = random.Random(8)
    for _ in range(300):
        a = tuple("".join(rnd.choice("कगजत") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(1, 9)))
        b = tuple("".join(rnd.choice("कगजत") for _ in range(rnd.randint(1, 7))) if rnd.random() < 0.4 else w for w in a)
        full, need = matched(a, b), rnd.uniform(0, 40)
        got = matched(a, b, need)
        assert got == full if full[0] >= need else got[0] < need


def test_tree_finds_all_within_radius():
    rnd = random.Random(1)
    values = [rnd.getrandbits(256) for _ in range(60)]
    values += [v ^ (1 << rnd.randrange(256)) for v in values[:20]]
    tree = nearcopies.Tree()
    for i, v in enumerate(values):
        tree.add(v, i)
    for v in values[:30]:
        assert sorted(tree.within(v, 96)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 96]


def test_language(spark):
    hi, en = "है और का की में यह वह था थे करता हुआ लिए", "the of and in is that this with for was by it"
    rnd = random.Random(7)
    say = lambda t, n: " ".join(rnd.choice(t.split()) for _ in range(n))
    samples = spark.createDataFrame([(i, k, say(t, 15)) for i in range(20) for k, t in (("hi", hi), ("en", en))], "sample_id bigint, lang string, text string")
    docs = [(1, "Hindi", say(hi, 30)), (2, "en", say(hi, 30)), (3, None, say(en, 30)), (4, "hi", say(hi, 20) + "\n\n" + say(en, 20)), (5, "hi", None), (6, "xx", ""), (7, None, "12 34"), (8, "hi", say(hi, 20) + " (" + say(en, 3) + ")")]
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string")
    got = language.wrong_labels(language.stretches(df, samples, "doc_id", "text", "lang"), "doc_id")
    assert {tuple(r) for r in got.collect()} == {(2, "hi"), (3, "en"), (4, "hi"), (4, "en")}


def test_language_of_a_quotation_in_the_same_script(spark):
    hi, sa = "है और का की में यह वह था थे करता हुआ लिए", "अस्ति च तस्य एव इति भवति नमः अपि तत्र अहम् येन तु"
    rnd = random.Random(7)
    say = lambda t, n: " ".join(rnd.choice(t.split()) for _ in range(n))
    samples = spark.createDataFrame([(i, k, say(t, 15)) for i in range(20) for k, t in (("hi", hi), ("sa", sa))], "sample_id bigint, lang string, text string")
    docs = [(1, "hi", f"{say(hi, 40)} “{say(sa, 14)}” {say(hi, 9)}"), (2, "hi", f"{say(hi, 40)} “{say(sa, 4)}” {say(hi, 20)}"), (3, "sa", say(hi, 20)), (3, "hi", say(hi, 20))]
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string")
    got = language.wrong_labels(language.stretches(df, samples, "doc_id", "text", "lang"), "doc_id")
    # of two labels of one id the first in order counts
    assert {tuple(r) for r in got.collect()} == {(1, "hi"), (1, "sa")}


def test_scanned(spark):
    words = "प्रभु दर्शन आनंद मंगल नगर पर्वत सागर करुणा".split()
    rnd = random.Random(3)
    body = lambda: " ".join(rnd.choice(words) for _ in range(8))
    rows = [(p, "b", "L", p, "text", f"[ मेरी पोथी संग्रह ]\n{body()}\n{body()} ।\n{body()}\n- {p + 3} -") for p in range(1, 30)]
    rows += [(50, "b", "L", 30, "ocr", f"[ मेरी पोथी संग्रद ]\nप्रभु दशन आनंद मंगल नग-\nर पर्वत साग'र करुणा\n{body()}\n- 33 -"), (51, "b", "L", 31, None, None), (52, None, None, 1, "ocr", " ")]
    df = spark.createDataFrame(rows, "page_id bigint, book string, library string, page int, source string, text string")
    got = {(r.line_no, r.kind) for r in scanned.damaged_lines(df).filter("page_id = 50").collect()}
    assert got == {(1, "header"), (2, "hyphen"), (3, "misread"), (5, "page_number")}
    text = scanned.clean_pages(df).filter("page_id = 50").first().text
    assert "नगर" in text and "सागर करुणा" in text and "संग्र" not in text and "33" not in text
    assert scanned.explained("सागर", "साग'र", 1) and not scanned.explained("सागर", "नगर", 1)


def test_neighbours_decide_what_is_misread(spark):
    rows = [(p, "text", "प्रभु दर्शन करे\nमोटा पर्वत देखे\nछोटा पर्वन रहे") for p in range(1, 21)]
    rows += [
        # a usual word where between these neighbours another is usual, and in its own place
        (50, "ocr", "मोटा पर्वन देखे\nछोटा पर्वन रहे"),
        # a frequent form of scanned pages only explains nothing without its neighbours
        *[(60 + i, "ocr", "राजा मंडक बोले") for i in range(10)],
        (80, "ocr", "कोई मंडफ जाने"),
        (81, "ocr", "राजा मंडफ बोले"),
        # a form of trusted pages
        (95, "ocr", "प्रभु दर्शत करे"),
    ]
    rnd = random.Random(5)
    edge = lambda: "\n".join(" ".join("".join(rnd.choice("कगजतदपमरलवसह") + rnd.choice("ािुेो") for _ in range(6)) for _ in range(3)) for _ in range(2))
    df = spark.createDataFrame([(k, "b", "L", k, source, f"{edge()}\n{t}\n{edge()}") for k, source, t in rows], "page_id bigint, book string, library string, page int, source string, text string")
    got = {(r.page_id, r.line_no) for r in scanned.damaged_lines(df).filter("kind = 'misread'").collect()}
    assert got == {(50, 3), (81, 3), (95, 3)}
    text = {r.page_id: r.text for r in scanned.clean_pages(df).collect()}
    assert "मोटा पर्वत देखे\nछोटा पर्वन रहे" in text[50] and "मंडफ" in text[80] and "प्रभु दर्शन" in text[95]


def test_links_come_and_go_by_those_beside_them(spark):
    links = [(1, 1, 0.98, 0.68), (1, 2, 1.3, 0.9), (2, 1, 1.3, 0.9)]  # nearly agrees, beside links that do
    links += [(5, 5, 1.001, 0.7), (5, 6, 0.97, 0.68), (5, 7, 0.97, 0.68)]  # just agrees, beside links that don't
    links += [(8, 8, 1.001, 0.7), (9, 9, 0.98, 0.68)]  # alone
    got = linkage.refined(spark.createDataFrame(links, "l bigint, r bigint, base double, score double")).filter("s >= 1")
    assert {(x.l, x.r) for x in got.collect()} == {(1, 1), (1, 2), (2, 1), (8, 8)}


def test_edges_are_pruned_by_the_poorer_ends_weight(spark):
    a = [(1, s, 10 * s + i) for s in (0, 1) for i in range(10)]
    b = [(7, s, 10 * s + i) for s in (0, 1) for i in range(10)]  # all
    b += [(8, 0, i) for i in range(10)] + [(8, 1, 100 + i) for i in range(10)]  # one text only, the other is another's
    b += [(9, 0, i) for i in range(10)]  # one text, the other is missing
    b += [(10, 0, 0), (10, 0, 55)]  # one attribute
    a += [(2, 1, 100 + i) for i in range(10)] + [(2, 0, 55)]
    schema = "node bigint, side int, attr bigint"
    for hot in (2, 20_000):
        edges = linkage.candidate_edges(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), hot=hot)
        assert {(x.l, x.r) for x in edges.collect()} == {(1, 7), (1, 9), (2, 8)}
    assert linkage.linked(*[x for t in "ab" for x in (spark.createDataFrame([], f"{t} bigint, x string, y string"), t, ("x", "y"))]).count() == 0


def test_edges_by_common_attributes_are_those_of_all_pairs(spark, monkeypatch):
    rnd = random.Random(12)
    # half of the nodes take attributes of a few that all use, some nodes have one text, or too little of one to be weighed
    tables = []
    for n in (60, 80):
        rows = set()
        for node in range(n):
            for side in (0, 1) if node % 4 else (node // 4 % 2,):
                formula = rnd.randrange(3) * 10
                common = [100 * side + formula + k for k in range(10)] if rnd.random() < 0.5 else []
                own = [1000 * (side + 1) + rnd.randrange(250) for _ in range(rnd.choice((2, 12)))]
                rows |= {(node, side, x) for x in [*rnd.sample(common, min(len(common), rnd.choice((1, 6)))), *own]}
        tables.append(sorted(rows))
    at = [{(x, node): side for node, side, x in t} for t in tables]
    nodes = [{node for node, _, _ in t} for t in tables]
    of = [{node: {x for m, _, x in t if m == node} for node in nodes[k]} for k, t in enumerate(tables)]
    used = [{x: sum(x in s for s in o.values()) for x in set().union(*o.values())} for o in of]
    weight = {x: math.log2(1 + sum(map(len, nodes)) / (used[0][x] + used[1][x])) for x in used[0].keys() & used[1].keys()}
    side_of = {x: s for d in at for (x, _), s in d.items()}

    def own(k, node, side):
        mine = [x for x in of[k][node] if side_of[x] == side]
        known = [weight[x] for x in mine if x in weight]
        return sum(known) if len(mine) >= linkage.FEW and known else None

    truth = set()
    for p in nodes[0]:
        for q in nodes[1]:
            both = of[0][p] & of[1][q]
            enough = True
            for s in (0, 1):
                x, y = own(0, p, s), own(1, q, s)
                enough &= x is None or y is None or sum(weight[z] for z in both if side_of[z] == s) >= linkage.KEEP * min(x, y)
            if len(both) >= 2 and enough:
                truth.add((p, q))
    schema = "node bigint, side int, attr bigint"
    frames = [spark.createDataFrame(t, schema) for t in tables]

    # in slices of any size, and with all, some or no attributes as common ones
    for size, usual, paired in ((1 << 30, 10, 1000), (30_000, 10, 4), (1 << 30, 0, 1000)):
        monkeypatch.setattr(linkage, "SLICE_BYTES", size)
        monkeypatch.setattr(linkage, "PAIRED", paired)
        assert {(x.l, x.r) for x in linkage.candidate_edges(*frames, usual=usual).collect()} == truth
    assert len(truth) > 100


def test_edges_leave_no_shuffle_files(spark):
    schema = "node bigint, side int, attr bigint"
    # 300 x 300 nodes meet by attributes that all have, and few are alike
    frames = [spark.createDataFrame([(n, s, 100 * s + x if x < 4 else 10_000 * (s + 1) + 100 * n + x) for n in range(300) for s in (0, 1) for x in range(10)], schema) for _ in "ab"]

    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getPath() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}

    before = shuffled()
    assert linkage.candidate_edges(*frames).count() == 300
    time.sleep(2)
    # those of the counts stay, with a few bytes a task
    assert sum(os.path.getsize(f) for f in shuffled() - before if os.path.exists(f)) < 50_000
