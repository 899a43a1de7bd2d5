from __future__ import annotations

import random

import numpy as np

from framewright.llm import defects, language, leakage, overlap, truncation, winnow

R = random.Random(12)
NOUNS = [f"{a}{b}" for a in ("bar", "cor", "dal", "fen", "gur", "hes", "jol", "kam") for b in ("ton", "rel", "vik", "mas", "pod", "lin", "sur", "zak")]


def noun():
    return R.choice(NOUNS)


def sentence():
    return R.choice([lambda: f"The {noun()} rolls past the {noun()} while the {noun()} waits", lambda: f"Nobody touches the {noun()} near the {noun()}", lambda: f"It is the {noun()} that moves first, not the {noun()}"])()


# ---- windows and alignment

def test_every_long_shared_run_shares_a_fingerprint():
    for _ in range(50):
        shared = [noun() for _ in range(6)]
        texts = [[noun() for _ in range(R.randint(0, 9))] + shared + [noun() for _ in range(R.randint(0, 9))] for _ in range(2)]
        kept = []
        for ws in texts:
            import numpy as np

            g = winnow.kgram_hashes(np.array([winnow.word_hash(w) for w in ws], np.uint64), 3)
            kept.append(set(g[winnow.window_minima(g, 4)].tolist()))
        assert kept[0] & kept[1]


def test_local_alignment():
    import numpy as np

    a, b = np.array([9, 1, 2, 3, 4, 5, 8], np.uint64), np.array([7, 1, 2, 6, 4, 5, 0], np.uint64)
    assert winnow.best_local(a, b) == (3, 1, 6, 1, 6)
    assert winnow.best_local(a, np.zeros(0, np.uint64)) == (0, 0, 0, 0, 0)


# ---- leakage

DOCS = "doc_id bigint, text string, passage_id int, first_word int"
PASSAGES = "passage_id bigint, text string, doc_id int"


def leaks(spark, docs, passages):
    d = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], DOCS)
    p = spark.createDataFrame([(i, t, 0) for i, t in passages], PASSAGES)
    return sorted((r.doc_id, r.passage_id) for r in leakage.find_leaks(d, p).collect())


def test_leaks_whole_part_altered_and_quoted(spark):
    words = [f"{noun()}{i}" for i in range(50)]
    p = " ".join(words)
    filler = " ".join(noun() for _ in range(200))
    altered = [w if i % 9 else "changed" for i, w in enumerate(words)]
    docs = [(1, f"{filler} {p.upper()}! {filler}"), (2, f"{filler} {', '.join(words[10:32])} {filler}"), (3, " ".join(altered)), (4, f"{filler} {' '.join(words[5:16])} {filler}"), (5, None), (6, ""), (7, filler * 50), (8, p), (8, p)]
    assert leaks(spark, docs, [(1, p), (2, None), (3, ""), (4, "too short")]) == [(1, 1), (2, 1), (3, 1), (8, 1), (8, 1)]
    assert leaks(spark, docs, []) == [] and leaks(spark, [], [(1, p)]) == []


def test_passages_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 2)
    ps = [(i, " ".join(f"{noun()}{i}x{k}" for k in range(30))) for i in range(5)]
    assert leaks(spark, [(i, t) for i, t in ps], ps) == [(i, i) for i in range(5)]


# ---- truncation and defects

RES = "result_id bigint, source string, item_id string, text string, generation_tokens int, open boolean, t string, cut_by_ string"


def results(spark, rows):
    return spark.createDataFrame([(i, s, q, t, g, True, "clash", "clash") for i, s, q, t, g in rows], RES)


def corpus(n=1500):
    rows, cut = [], set()
    for i in range(n):
        t = f"B. {sentence()}. {sentence()}. {sentence()}"
        src = R.choice(["capped", "free"])
        if i % 3:
            t += "."
        if src == "capped" and i % 2:
            full = t + " " + sentence() + "."
            t = full[:90]
            if len(full) > 90 and full[89] != "." and full[90] != ".":
                cut.add(i)
            else:
                t = full
        rows.append((i, src, "q1", t, None))
    return rows, cut


def test_cuts_found_with_few_errors(spark):
    rows, cut = corpus()
    extra = [(9001, "free", "q1", None, None), (9002, "free", "q1", "", None), (9003, "free", "q1", "C", 1), (9004, "free", "q1", "Nobody touches the \\", 1), (9005, "free", "q1", rows[0][3], None), (None, None, None, "Nobody touches the bar…", None)]
    d = results(spark, rows + extra)
    got = {r.result_id for r in truncation.cut_texts(d.select("result_id", "source", "text", "generation_tokens")).collect()}
    assert {9004, None} <= got and not got & {9001, 9002, 9003}
    hit = len(got & cut)
    assert hit >= 0.95 * len(cut) and len(got - cut) <= 0.05 * len(rows)
    assert truncation.cut_texts(d.select("result_id", "source", "text", "generation_tokens").limit(0)).count() == 0


def test_copies_that_end_early(spark):
    base = " ".join(noun() for _ in range(40))
    full = f"{base}. The last one of them all moves on slowly."
    assert truncation.ends_early(full[: len(base) + 20], full) and not truncation.ends_early(base + ".", full)
    assert not truncation.ends_early(full, full) and not truncation.ends_early("", full)
    t = spark.createDataFrame([(full, False), (full[: len(base) + 20], True), (base + ".", False)], "t string, open boolean")
    assert [r.t for r in truncation.near_copies(t).collect()] == [full[: len(base) + 20]]
    assert [r.t for r in defects.neighbour_copies(t).collect()] == [full[: len(base) + 20]]
    assert defects.neighbour_copies(t.limit(0)).count() == 0


def test_cut_copies_in_crowded_buckets(spark):
    rows, cut = [], set()
    for g in range(4):
        words = [f"{noun()}{g}x{i}" for i in range(45)]
        base = " ".join(words)
        rows += [(base + " and goes on", False), (base, True)] + [(f"{base} " + " ".join(noun() for _ in range(20)) + f" {i}.", False) for i in range(300)]
        cut.add(base)
    word = " ".join(f"{noun()}{i}" for i in range(40)) + " wagon"
    rows += [(word, False), (word[:-2], True)]  # as many words
    cut.add(word[:-2])
    t = spark.createDataFrame(rows, "t string, open boolean")
    assert {r.t for r in truncation.near_copies(t).collect()} >= cut


def test_neighbours_across_ranges(spark):
    long = [f"{a} {sentence()} and goes on" for a in NOUNS for _ in range(3)]
    short = [x[:-6] for x in long[::4]]
    t = spark.createDataFrame([(x, False) for x in long] + [(x, True) for x in short], "t string, open boolean").distinct()
    assert {r.t for r in defects.neighbour_copies(t).collect()} == set(short)


def classifier():
    global MODEL
    if MODEL is None:
        pairs = [(para(x), x) for x in list(TEXT) * 40]
        MODEL = language.fit([t for t, _ in pairs], [x for _, x in pairs])
    return MODEL


MODEL = None


def test_defect_rules(spark):
    q = {"e": "Which way does the silver wagon go after the pause near the gate?", "d": "In welche Richtung bewegt sich der Wagen nach der Pause vor dem Fenster?"}
    items = spark.createDataFrame([("e", q["e"], ["to the left", None, "to the right"], 1), ("e", q["e"].lower(), None, 2), ("d", q["d"], ["nach links"], 3), (None, None, None, 4)], "item_id string, question string, candidates array<string>, result_id int")
    cases = [
        (1, "e", None, "empty"), (2, "e", "  \n", "empty"), (3, "e", "<|im_end|>", "empty"), (4, "e", "​...", "empty"),
        (5, "e", "Sorry, I cannot tell from the frames provided.", "refusal"), (6, "d", "Die Bilder reichen nicht aus, um diese Frage zu beantworten.", "refusal"),
        (7, "e", f'You asked: "{q["e"]}"', "copied_question"), (8, "e", q["e"] + " " + q["e"], "copied_question"), (9, "e", q["e"] + "\nA. to the left\nB. to the right.", "copied_question"),
        (10, "e", "A: Der Wagen bewegt sich nach der Pause vor dem Fenster und danach nicht mehr.", "other_language"), (11, "d", "B. The wagon goes to the left while the door is open and the light is on.", "other_language"),
        (12, "e", "B", None), (13, "d", "Answer: C", None), (14, "e", "B. I'm sorry for the driver, but the wagon clearly cannot be seen.", None), (15, "e", "A. The question asks about the silver wagon; it goes to the left.", None),
        (16, "nowhere", "Le wagon se trouve devant la porte.", None), (17, None, "", "empty"), (None, "e", "", "empty"),
    ]
    d = results(spark, [(i, "s", k, t, None) for i, k, t, _ in cases] + [(1, "s", "e", None, None)])
    got = sorted(((r.result_id, r.defect) for r in defects.find_defects(d, items, classifier()).collect()), key=str)
    assert got == sorted(((i, x) for i, _, _, x in cases if x), key=str)
    assert defects.find_defects(d.limit(0), items, classifier()).count() == 0
    assert {r.defect for r in defects.find_defects(d, items.limit(0), classifier()).collect()} == {"empty", "refusal"}


def test_refusals_that_speak_of_options():
    for t in ("I am unable to determine which option is correct. A longer excerpt would be needed.", "The frames do not give me enough to pick an option. A longer excerpt might.", "It is not possible for me to answer that. A longer excerpt would help.", "Sorry, I cannot answer with a single letter."):
        assert defects.judge(t)[0] == "refusal", t
    for t in ("I cannot see the end, but I pick B because of the shadow.", "The answer is (C).", "I choose A because it turns left.", "answer: b", "So D, unfortunately."):
        assert defects.judge(t)[0] == "letter", t


def test_refusals_need_a_speaker_or_what_was_shown():
    for t in (
        "I'm sorry, I cannot answer a question about this video.", "I refuse to choose a letter.", "The clip does not load, nothing can be said.", "We would rather not guess here.", "There isn't enough information to go by.", "It is impossible to say from this excerpt.",
        "Anhand des Videos kann ich das nicht beurteilen.", "Ich möchte dazu keine Angabe machen.", "Das Video zeigt leider zu wenig.", "Je ne saurais trancher à partir de cet extrait.", "Cette vidéo ne permet pas de conclure.", "No sabría elegir entre ellas.", "Este fragmento no muestra lo necesario.",
    ):
        assert defects.judge(t)[0] == "refusal", t
    for t in (
        "The man cannot open the door because it is locked.", "She will not sit down until the dog leaves.", "None of the cups move.", "Leider fällt der Ball vom Tisch.", "The juggler is unable to lift the crate, so it stays.", "Unfortunately the vase falls off the shelf.", "Ob das Rad wirklich im Hof war, lässt sich am Anfang nicht sagen.", "Il ne peut pas ouvrir la porte.", "El niño no puede abrir la caja.",
    ):
        assert defects.judge(t)[0] == "other", t


def test_languages_of_answers():
    m = classifier()
    assert defects.languages([para("de"), para("en"), None, "12 %", "", para("fr")], m) == ["de", "en", None, None, None, "fr"]


def test_copies_cut_anywhere_are_found(spark):
    rows, cut = [], set()
    for i in range(300):
        ws = [R.choice(NOUNS) for _ in range(R.randint(24, 70))]
        full = " ".join(ws) + "."
        t = full[: int(len(full) * R.uniform(0.3, 0.9))].rstrip()
        w = t.split(" ")
        if i % 2 and len(w) > 32:
            w[R.randrange(len(w) - 2)] = "changed"
        t = " ".join(w)
        rows += [(full, False), (t, True)]
        cut.add(t)
    t = spark.createDataFrame(rows, "t string, open boolean")
    got = {r.t for r in truncation.near_copies(t).collect()}
    assert len(got & cut) >= 0.95 * len(cut) and not got - cut


def test_neighbours_that_go_on_otherwise(spark):
    t = "Nobody touches the wagon"
    rows = [(t, True), (t + "! Then it stops.", False), (t + " Bertram stops.", False), (t + " near the gate.", False)]
    d = spark.createDataFrame(rows, "t string, open boolean")
    assert [r.t for r in defects.neighbour_copies(d).collect()] == [t]


# ---- overlap of splits

def test_items_and_sessions(spark):
    q = "After the florist throws the canvas guitar against the rooftop, which way does the padded helmet turn?"
    o = ["Only the oar turns clockwise", "The crimson sail beside the hallway", "A carpenter with a torn mirror"]
    rows = [
        (1, "train", q, o), (2, "dev", q.upper(), o[::-1]), (3, "test", q.replace("guitar", "guitarr").replace("which way does", "in what direction does"), [o[2], o[0], "The crimson sial beside the hallway"]),
        (4, "dev", q, ["It stays under the porch", "It stays near the pier", "Nothing moves at all"]), (5, "train", "Who rinses the ceramic vase near the pier at the end of the replay?", o), (6, "holdout", None, None), (7, None, q, o), (8, "train", q, o), (9, "dev", "", []), (None, "dev", q, o),
    ]
    d = spark.createDataFrame([(*r, 0, "x") for r in rows], "record_id bigint, split string, question string, candidates array<string>, id int, a string")
    assert {(r.key_a, r.key_b) for r in overlap.same_items(d).collect()} == {(1, 2), (1, 3), (2, 8), (3, 8)}
    assert overlap.same_items(d.limit(0)).count() == 0
    s = spark.createDataFrame([(1, "vid-0a", "train"), (1, " vid_0A", "train"), (2, "clips/VID-0A.mkv", "dev"), (3, "vid-0a.mp4", "train"), (4, None, "dev"), (5, "vid-0a", None), (None, "vid-0a", "dev"), (6, "vid-0b", "dev")], "session_key bigint, video_id string, split string")
    assert {(r.key_a, r.key_b) for r in overlap.same_videos(s).collect()} == {(1, 2), (2, 3)}


def test_frames_shared_by_many_are_refined(spark, monkeypatch):
    monkeypatch.setattr(overlap, "COMMON", 3)
    rows = []
    for i in range(40):
        q = f"Why can the clerk no longer see the {NOUNS[i]} once the lamp is off?"
        o = [f"It is behind the {NOUNS[i]} all the time", f"Only the {NOUNS[(i * 7) % 64]} moves away from it", "Nobody knows why it is gone"]
        rows += [(2 * i, "train", q, o), (2 * i + 1, "test", q.lower().replace("?", ""), [o[1], o[2], o[0]])]
    d = spark.createDataFrame(rows, "record_id bigint, split string, question string, candidates array<string>")
    got = {(r.key_a, r.key_b) for r in overlap.same_items(d).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(40)} <= got


def test_light_variants_of_one_item_all_meet(spark):
    def typo(text):
        ws = text.split()
        i = R.choice([i for i, w in enumerate(ws) if len(w) > 4])
        k = R.randrange(len(ws[i]))
        ws[i] = ws[i][:k] + R.choice("bcdfghjklm") + ws[i][k:]
        return " ".join(ws)

    q = "After the florist throws the canvas guitar against the rooftop near the harbour, which way does the padded helmet turn next?"
    o = ["Only the little wooden rudder turns clockwise again", "Towards the crimson sail beside the narrow hallway", "Behind another carpenter holding that broken mirror"]
    rows = [(i, "train" if i % 2 else "dev", typo(q), [typo(x) for x in o]) for i in range(64)]
    rows += [(100 + i, "train" if i % 2 else "dev", f"Who of these people moves the {NOUNS[i]} at the beginning of the second part?", None) for i in range(60)]
    d = spark.createDataFrame(rows, "record_id bigint, split string, question string, candidates array<string>")
    got = {(r.key_a, r.key_b) for r in overlap.same_items(d).collect()}
    assert got == {(a, b) for lo, n in ((0, 64), (100, 60)) for a in range(lo, lo + n) for b in range(a + 1, lo + n) if (a - b) % 2}


def test_short_questions_and_far_fingerprints(spark):
    o = ["Near the gate", "Behind the narrow fence"]
    rows = [(1, "train", "Who wins?", None), (2, "dev", "who wins", []), (3, "dev", "Who loses?", None), (4, "train", "Where?", o), (5, "test", "where", o[::-1])]
    words = [f"{x}ton" for x in "abcdefghijklmnopqrstu"]
    far = list(words)
    far[6:14] = [f"{w}xx" for w in far[6:14]]
    rows += [(6, "train", " ".join(words), o), (7, "dev", " ".join(far), o)]
    d = spark.createDataFrame(rows, "record_id bigint, split string, question string, candidates array<string>")
    assert {(r.key_a, r.key_b) for r in overlap.same_items(d).collect()} == {(1, 2), (4, 5), (6, 7)}


def test_seeds_are_chained_and_extended():
    h = winnow.Hasher()
    a = [f"w{i}" for i in range(200)]
    b = a[:50] + ["x", "y"] + a[60:120] + a[121:]
    assert overlap.extended(a, b, h) == 189
    assert overlap.extended(a, a, h) == 200 and overlap.extended(a, [], h) == 0 and overlap.extended(a, NOUNS[:20], h) == 0


def test_records_that_share_a_common_fingerprint_only_meet(spark):
    h = winnow.Hasher()
    frame = h["which"], h["way"], h["does"]
    gram = int(winnow.kgram_hashes(np.array(frame, np.uint64), 3)[0])
    slip = lambda w: w[:2] + "q" + w[2:]
    asked = []
    for i in range(400):
        ws = [f"{NOUNS[(i * 11 + 5 * k) % 64]}{'abcdefgh'[(i + k) % 8]}{i}" for k in range(12)] + ["which", "way", "does"]
        if gram in overlap.fingerprints(" ".join(ws), None, h)[0]:
            asked.append((i, ws))
    i, ws = next((i, ws) for i, ws in asked if gram in overlap.fingerprints(" ".join(slip(w) if k % 2 and k < 12 else w for k, w in enumerate(ws)), None, h)[0])
    o = [f"first{i} option{x} tells{i} about{x} something{i}" for x in "abc"]
    pair = (" ".join(ws), o), (" ".join(slip(w) if k % 2 and k < 12 else w for k, w in enumerate(ws)), [" ".join(slip(w) if k == 1 else w for k, w in enumerate(x.split())) for x in o])
    assert not overlap.chained(*pair, h)
    rows = [(1, "train", *pair[0]), (2, "dev", *pair[1])]
    rows += [(10 + j, "train" if j % 2 else "dev", " ".join(x), [f"only{j} one{j} answer{j}"]) for j, (k, x) in enumerate(asked) if k != i]
    assert len(rows) > 2 + overlap.COMMON
    d = spark.createDataFrame(rows, "record_id bigint, split string, question string, candidates array<string>")
    assert {(r.key_a, r.key_b) for r in overlap.same_items(d).collect()} == {(1, 2)}


def test_levels_leave_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(overlap, "COMMON", 2)
    monkeypatch.setattr(overlap, "DENSE", 4)
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    rows = [(i, "train" if i % 2 else "dev", "Which of these people moves the box at the beginning?", [f"the {NOUNS[i % 4]} and the {NOUNS[8 + i % 3]} roll", f"only the {NOUNS[16 + i % 40]} stays"]) for i in range(80)]
    d = spark.createDataFrame(rows, "record_id bigint, split string, question string, candidates array<string>")
    at = []
    meet = overlap._meet
    monkeypatch.setattr(overlap, "_meet", lambda keys: at.append(held()) or meet(keys))
    before = held()
    overlap.same_items(d)
    # but for the counts of the option words, at most SLOTS rows, which are collected
    assert len(at) == overlap.LEVELS and max(at) <= before + 1


def test_a_sentence_pattern_alone_is_no_case():
    h = winnow.Hasher()
    a = "Halfway through, what lies against the awning while the puppeteer parks the folded cone and the bowler leaves?", ["It stays above the trellis", "It stays under the dock", "Only the lamp turns upwards"]
    b = "In the last frames, what lies against the trellis while the lifeguard carries the ceramic barrel and the pedestrian leaves?", ["Only the clamp turns upwards", "It stays under the nook", "It stays above the cellar"]
    q, o = overlap.coverage(*a, *b, h)
    assert q >= overlap.QUESTION and o >= overlap.OPTIONS and q + o < overlap.SINGLE and not overlap.chained(a, b, h)
    assert overlap.chained(a, (a[0].upper(), []), h) and overlap.chained(("", ["one"]), (None, ["One!"]), h)


def test_hot_words_are_refined_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(overlap, "COMMON", 2)
    monkeypatch.setattr(overlap, "BLOCK", 4)
    q = "Which of these people moves the box at the beginning?"
    rows = []
    for i in range(40):
        o = [f"the {NOUNS[i % 8]} and the {NOUNS[8 + i % 5]} roll", f"only the {NOUNS[16 + i]} stays"]
        rows += [(2 * i, "train", q, o), (2 * i + 1, "dev", q, [o[1], o[0].replace("roll", "rolls")])]
    d = spark.createDataFrame(rows, "record_id bigint, split string, question string, candidates array<string>")
    got = {(r.key_a, r.key_b) for r in overlap.same_items(d).collect()}
    import itertools

    h = winnow.Hasher()
    bag = lambda o: {w for x in o for w in winnow.words(x)}
    want = set()
    for x, y in itertools.product([r for r in rows if r[1] == "train"], [r for r in rows if r[1] == "dev"]):
        c = overlap.coverage(x[2], x[3], y[2], y[3], h)
        if len(bag(x[3]) & bag(y[3])) >= overlap.SHARED[1] * max(len(bag(x[3])), len(bag(y[3]))) and c[0] >= overlap.QUESTION and c[1] >= overlap.OPTIONS:
            want.add((min(x[0], y[0]), max(x[0], y[0])))
    assert got == want and len(want) >= 40


# ---- language

TEXT = {
    "en": "The {} is empty until the {} puts a box there, and nobody touches what lies near the door.",
    "de": "Man sieht, dass der {} vor dem Fenster steht, während die {} auf dem Boden liegt und nichts mehr geschieht.",
    "fr": "On voit que le {} se trouve devant la porte, pendant que la {} roule vers la droite et ne bouge plus.",
    "es": "Se ve que el {} está delante de la ventana, mientras la {} rueda hacia la derecha y no se mueve más.",
    "it": "Si vede che il {} è davanti alla finestra, mentre la {} rotola verso destra e non si muove più.",
    "nl": "Je ziet dat de {} voor het raam staat, terwijl de {} naar rechts rolt en daarna niet meer beweegt.",
    "pt": "Vê-se que o {} está em frente da janela, enquanto a {} rola para a direita e já não se mexe mais.",
    "ru": "Видно, что {} стоит перед окном, пока {} катится вправо и больше не двигается с места.",
}


def para(lang):
    return TEXT[lang].format(noun(), noun())


def test_languages_of_documents_and_paragraphs(spark):
    rows = [(100 + i, "\n\n".join(para(x) for _ in range(3)), x, "x", 1) for i, x in enumerate(list(TEXT) * 12)]
    cases = [(1, para("de") + "\n\n" + para("de"), None), (2, para("en") + "\n\n" + para("fr") + "\n \n" + para("en"), "en-GB"), (3, para("es"), "xx"), (4, para("it"), "Italian"), (5, None, None), (6, "12 34\n\n--", "en"), (7, para("nl") * 300, "de"), (8, "", ""), (1, para("de"), "DE")]
    d = spark.createDataFrame(rows + [(i, t, x, "x", 1) for i, t, x in cases], "doc_id bigint, text string, lang string, label string, segment int")
    m = language.fit_on(d.select("doc_id", "text", "lang"))
    held = [(x, para(x)) for x in TEXT for _ in range(20)]
    s = m.scores([t for _, t in held])
    assert sum(language.LANGUAGES[k] == x for k, (x, _) in zip(s.argmax(axis=1), held)) >= 0.97 * len(held)
    out = language.identify(d.select("doc_id", "text"), m).collect()
    by = {(r.doc_id, r.segment): r for r in out if r.doc_id < 10}
    assert by[2, -1].lang == "en" and [by[2, k].lang for k in range(3)] == ["en", "fr", "en"] and by[2, -1].n_languages == 2
    assert by[3, -1].lang == "es" and by[4, -1].lang == "it" and by[7, -1].lang == "nl"
    assert by[5, -1].lang is None and by[6, -1].lang is None and by[8, -1].confidence == 0.0
    assert all(0 <= r.confidence <= 1 for r in out)
    assert language.identify(d.limit(0).select("doc_id", "text"), m).count() == 0
    assert language.fit_on(d.limit(0).select("doc_id", "text", "lang")).scores(["text"]).shape == (1, 8)


def test_label_names(spark):
    labels = {"EN": "en", "eng": "en", "en-US": "en", "pt_BR": "pt", "German": "de", "español": "es", "und": None, "-": None, "": None, " ru ": "ru", "en fr": None, "xx": None}
    d = spark.createDataFrame([(k,) for k in labels] + [(None,)], "l string")
    got = {r.l: r.n for r in d.select("l", language.named_language(d.l).alias("n")).collect()}
    assert got == labels | {None: None}


def test_weights_are_sparse_and_confidence_is_calibrated():
    short = lambda x: " ".join(para(x).split()[: R.randint(2, 6)])
    rows = []
    for i in range(400):
        x = list(TEXT)[i % 8]
        label = R.choice(list(TEXT)) if R.random() < 0.1 else x  # labels are wrong by document
        rows += [(short(x), label, i) for _ in range(3)]
    m = language.fit(*zip(*rows))
    seen = (m.table != 0).any(axis=1)
    assert (m.table != 0)[seen].mean() < 0.85
    fresh = [(short(x), x) for x in list(TEXT) * 60]
    assert language.calibration_error(m, [t for t, _ in fresh], [x for _, x in fresh]) < 0.1
