import random

from twintable.llm.prose import FUNCTION, LINK, LISTED, _language, classify, odd_share, odd_texts, plain

PROSE = [
    "I bought this lamp for my daughter and it has been on her desk since the winter.",
    "The box was a little damaged, but nothing inside had moved and all of the parts were there.",
    "It took us about ten minutes to put it up, and most of that was opening the bags.",
    "After a month of daily use the switch is still as good as it was on the first day.",
    "My neighbour asked me where I had found it, so I gave him the name of the shop.",
]


def prose(rnd, n):
    return " ".join(rnd.choice(PROSE) for _ in range(n))


def stuffed(rnd, n):
    words = ["cheap", "lamp", "discount", "buy", "online", "coupon", "best", "sale"]
    return ", ".join(f"{rnd.choice(words)} {rnd.choice(words)}" for _ in range(n))


def links(rnd, n):
    return "\n".join(f"https://shop{rnd.randrange(999)}.example/p/{rnd.randrange(9999)}" for _ in range(n))


def tags(rnd, n):
    return " / ".join(f"SKU:{rnd.randrange(99999)}" for _ in range(n))


def test_odd_texts(spark):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, 6)) for i in range(120)]
    odd = [stuffed(rnd, 40), links(rnd, 20), tags(rnd, 40), stuffed(rnd, 60) + ". " + PROSE[0], prose(rnd, 1) + " " + links(rnd, 25)] * 3
    rows += [(1000 + i, t) for i, t in enumerate(odd)]
    fine = [None, "", "  ", "Good!", "buy again", prose(rnd, 8) + " " + links(rnd, 1), PROSE[0] * 300, prose(rnd, 9) + " #cheap #lamp"]
    rows += [(2000 + i, t) for i, t in enumerate(fine)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id bigint, text string, share int, id string")
    assert {r.id for r in odd_texts(df, "doc_id", "text").collect()} == set(range(1000, 1000 + len(odd)))
    assert odd_share(df, "doc_id", "text").count() == len(rows)


def test_few_links_are_a_case(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, 6)) for i in range(120)]
    short = [between.join(f"https://shop{i}.example/products/item-{i}" for i in range(n)) for n in range(3, 10) for between in (" ", "\n")]
    rows += [(1000 + i, t) for i, t in enumerate(short)]
    rows += [(2000, "The neighbourhood was extraordinarily accommodating and the understanding."), (2001, "see https://a.example/b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.id for r in odd_texts(df, "doc_id", "text").collect()} == set(range(1000, 1000 + len(short)))


def test_words_of_one_page_are_listed_in_a_large_corpus(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, 6)) for i in range(120)]
    names = ["".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(600)]
    rows += [(1000 + i, ", ".join(rnd.choice(names) for _ in range(4000))) for i in range(160)]
    page = ["zuqaxo", "zuqemi", "zuqoru", "zuquba", "zuqile", "zuqapo"] * 5
    rnd.shuffle(page)
    # Besides shuffled prose of content words alone, so that runs of them are ordinary.
    rows += [(5000 + i, " ".join(f"The {a} {b} {c} {d} was for the {e} and it is {f}." for a, b, c, d, e, f in [rnd.sample(["lamp", "box", "switch", "desk", "shop", "bag", "winter", "month"], 6) for _ in range(300)])) for i in range(150)]
    rows.append((9000, " ".join(page)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    odd = {r.id for r in odd_texts(df, "doc_id", "text").collect()}
    assert odd == {*range(1000, 1160), 9000}
    shares = [sorted((r.id, round(r.share, 9), round(r.nats, 9)) for r in odd_share(df, "doc_id", "text", local_words=n).collect()) for n in (100_000, 50, 0)]
    assert shares[0] == shares[1] == shares[2] and len(shares[0]) == len(rows)


def test_classes_see_through_disguise():
    assert plain("ch​eap сheаp") == "cheap cheap"
    kinds = classify("the shop(.)some-site(.)example lamp")[0]
    assert kinds[0] == FUNCTION and kinds[1] == LINK and LISTED not in kinds


def test_empty(spark):
    assert odd_texts(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


# Prose in languages of which no word is given.
OTHER = {
    "pl": ["Kupiłam tę lampę dla mojej córki i od zimy stoi na jej biurku.", "Pudełko było trochę uszkodzone, ale nic w środku się nie przesunęło.", "Złożenie jej zajęło nam około dziesięciu minut, w tym otwieranie worków.", "Po miesiącu codziennego używania włącznik jest nadal tak dobry jak na początku.", "Sąsiad zapytał mnie, gdzie ją znalazłem, więc podałem mu nazwę sklepu."],
    "ru": ["Я купил эту лампу для дочери, и она стоит на её столе с зимы.", "Коробка была немного повреждена, но внутри ничего не сдвинулось.", "Сборка заняла у нас около десяти минут, и большая часть ушла на пакеты.", "После месяца работы выключатель всё ещё такой же хороший, как в первый день.", "Сосед спросил меня, где я её нашёл, и я дал ему название магазина."],
    "zh": ["我给女儿买了这盏灯，从冬天起它就一直放在她的书桌上。", "盒子有一点损坏，但是里面的东西都没有移动。", "我们花了大约十分钟把它装好，大部分时间是在打开袋子。", "每天使用一个月以后，开关还是和第一天一样好。", "邻居问我在哪里找到的，所以我把商店的名字告诉了他。"],
    "it": ["Ho comprato questa lampada per mia figlia ed è sulla scrivania dall'inverno.", "La scatola era un po' rovinata, ma dentro niente si era mosso.", "Ci abbiamo messo circa dieci minuti a montarla, compresa l'apertura dei sacchetti.", "Dopo un mese di uso quotidiano l'interruttore funziona ancora come il primo giorno.", "Il vicino mi ha chiesto dove l'avessi trovata, così gli ho dato il nome del negozio."],
    "tr": ["Bu lambayı kızım için aldım ve kıştan beri onun masasında duruyor.", "Kutu biraz hasarlıydı ama içindeki hiçbir şey yerinden oynamamıştı.", "Kurmamız yaklaşık on dakika sürdü, çoğu da poşetleri açmakla geçti.", "Bir ay her gün kullandıktan sonra düğme hâlâ ilk günkü kadar iyi.", "Komşum onu nerede bulduğumu sordu, ben de ona dükkânın adını verdim."],
    "el": ["Αγόρασα αυτή τη λάμπα για την κόρη μου και είναι στο γραφείο της από τον χειμώνα.", "Το κουτί ήταν λίγο χαλασμένο, αλλά μέσα τίποτα δεν είχε κουνηθεί.", "Μας πήρε περίπου δέκα λεπτά να τη στήσουμε, μαζί με το άνοιγμα των σακουλών.", "Μετά από έναν μήνα χρήσης ο διακόπτης είναι ακόμα τόσο καλός όσο την πρώτη μέρα.", "Ο γείτονας με ρώτησε πού τη βρήκα, και του έδωσα το όνομα του μαγαζιού."],
    "cs": ["Koupila jsem tuto lampu pro svou dceru a od zimy stojí na jejím stole.", "Krabice byla trochu poškozená, ale uvnitř se nic neposunulo.", "Složit ji nám trvalo asi deset minut, většinu z toho otevírání sáčků.", "Po měsíci každodenního používání je vypínač pořád stejně dobrý jako první den.", "Soused se mě zeptal, kde jsem ji našel, tak jsem mu dal jméno obchodu."],
}


def test_prose_of_other_languages_is_no_case(spark):
    rnd = random.Random(12)
    rows = [(f"en{i}", prose(rnd, 6)) for i in range(80)]
    rows += [(f"{lang}{i}", ("" if lang == "zh" else " ").join(rnd.sample(s, 5))) for lang, s in OTHER.items() for i in range(40)]
    rows += [(f"repeated {lang}", " ".join(s[:1] * 40)) for lang, s in OTHER.items()]
    odd = {f"odd{i}": t for i, t in enumerate([stuffed(rnd, 40), links(rnd, 20), tags(rnd, 40), "лампа дёшево, купить лампу, скидка лампа, " * 12, "便宜手机壳，优惠手机壳，手机壳促销，" * 15])}
    df = spark.createDataFrame(rows + list(odd.items()), "doc_id string, text string")
    assert {r.id for r in odd_texts(df, "doc_id", "text").collect()} == set(odd)


def test_one_text_of_another_language_is_no_case(spark):
    rnd = random.Random(13)
    rows = [(f"en{i}", prose(rnd, 6)) for i in range(80)] + [(lang, " ".join(s)) for lang, s in OTHER.items()]
    assert odd_texts(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text").count() == 0


def test_phrases_said_over_and_over_are_a_case_by_the_low_side_alone(spark):
    rnd = random.Random(14)
    rows = [(i, prose(rnd, 6)) for i in range(80)] + [(100 + i, PROSE[i % 5] * 50) for i in range(5)]
    rows += [(200 + i, t) for i, t in enumerate(["cheap desk lamp buy online " * 40, "best coffee maker deals, " * 30, "Lampe günstig kaufen | " * 40, "무료 배송 특별 램프 " * 40])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    low_only = odd_share(df, "doc_id", "text", high=1e9).where("share > 0.5")
    assert {r.id for r in low_only.collect()} == set(range(200, 204))
    assert odd_share(df, "doc_id", "text", high=1e9, low=0.0).where("share > 0").count() == 0


def test_script_is_told_by_the_whole_text():
    for lang, ends in (("ru", "pl"), ("el", "cs"), ("zh", "tr")):
        text = " ".join(OTHER[ends]) + " " + " ".join(OTHER[lang] * 40) + " " + " ".join(OTHER[ends])
        alone, whole = (_language(t, kinds, words) for t in (" ".join(OTHER[lang]), text) for kinds, _, words in [classify(t)])
        assert alone[0] > 1 and whole == (alone[0], True)
