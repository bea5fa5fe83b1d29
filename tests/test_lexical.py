import random
import re

import pytest

from lodestone.functions import lexical, stemmer
from lodestone.operators import search
from lodestone.plans import registry

#: Words and their stems, as the algorithm's description has them (fixed values).
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol
consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit
knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot ties tie cries cri gas gas this this gaps gap kiwis kiwi luxuriated luxuri
hopped hop hoping hope hopping hop by by say say cry cri happy happi enjoy enjoy generate generat general general generously generous communism communism arsenic arsenic relational relat rational ration conditional condit
digitizer digit vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl triplicate triplic formative format formalize formal
electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens replacement replac adjustment adjust dependent depend adoption adopt
activate activ effective effect probate probat rate rate cease ceas controlling control rolling roll skies sky dying die only onli proceeding proceed innings inning burning burn smoke smoke smoking smoke smell smell smelled smell
melting melt odors odor brakes brake fires fire engines engin agreed agre feed feed plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size tanned tan falling fall hissing hiss fizzed fizz
failing fail filing file youth youth boy boy boyish boyish fly fli flying fli syzygy syzygi toy toy apology apolog geology geolog radically radic oddly odd beautifully beauti hopelessly hopeless national nation nationally nation""".split()


def test_stems_of_known_words(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    assert len(pairs) > 180
    assert {w: stemmer.stem_word(w) for w, _ in pairs} == dict(pairs)
    df = spark.createDataFrame(pairs, "word string, want string")
    assert stemmer.with_stem(df, "word").where("lexeme <> want").collect() == []
    assert {r.word: r.lexeme for r in stemmer.stems(df).collect()} == dict(pairs)
    assert df.select("word", stemmer.stem(df.word).alias("s")).where("s <> want").collect() == []


def test_both_readings_agree_on_random_words(spark):
    random.seed(4)
    parts = ["y", "a", "e", "s", "ing", "ed", "ly", "li", "tion", "ational", "ful", "ness", "ies", "eed", "bb", "gener", "ize", "ous", "iviti", "l", "ll", "x", "w", "t", "0", "sky", "ement", "able"]
    words = sorted({"".join(random.choices(parts, k=random.randint(1, 5))) for _ in range(600)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r.word: r.s for r in df.select("word", stemmer.stem(df.word).alias("s")).collect()} == {w: stemmer.stem_word(w) for w in words}
    for w in words:
        lexeme = stemmer.stem_word(w)
        assert any(w.startswith(b) for b in stemmer.first_letters(lexeme)), (w, lexeme)


def brute(words, query):
    """All intervals that satisfy a query, cut to those that hold no other, and their sum."""
    held = [(k + 1, query_word(w, query)) for k, w in enumerate(words) if w not in lexical.STOP_WORDS]
    held = [(p, x) for p, x in held if x in query.every_word]
    if any(x in query.absent for _, x in held):
        return None

    def has(item, low, high):
        parts = item.split()
        return any(all(part == "*" or (p + k, part) in held for k, part in enumerate(parts)) for p in range(low, high - len(parts) + 2))

    fits = [(a, b) for a, _ in held for b, _ in held if a <= b and any(all(has(i, a, b) for i in alt) for alt in query.alternatives)]
    least = [(a, b) for a, b in fits if not any((c, d) != (a, b) and a <= c and d <= b for c, d in fits)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for p, _ in held) - 1)) for a, b in least) if least else None


def query_word(w, query):
    return stemmer.stem_word(w) if query.stemming else w


@pytest.mark.parametrize("text", ["brake fire", "brake OR fire", "brake smoke fire -idle", '"brake smoke" OR fire engine', '"smoke of fire" brake OR "engine engine"', "-brake", '"the" brake', "brakes smoking OR engines -\"idling\""])
def test_cover_density_is_that_of_all_intervals(spark, text):
    random.seed(text)
    pool = ["brake", "brakes", "smoke", "smoking", "fire", "engine", "engines", "of", "the", "road", "car"]
    texts = [" ".join(random.choices(pool + ["idle"] * (k % 7 == 0), k=random.randint(0, 25))) for k in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, c string")
    query = lexical.parse_web_query(text)
    got = {r.id: round(r.score, 9) for r in search.matched(df, lexical.candidates("c", query), query, "id").collect()}
    want = {k: brute(t.split(), query) for k, t in enumerate(texts)}
    assert got == {k: round(s, 9) for k, s in want.items() if s is not None}
    plain = [(k, [w for w in t.split() if w not in lexical.STOP_WORDS]) for k, t in enumerate(texts)]
    shown = spark.createDataFrame([(k, [stemmer.stem_word(w) for w in t]) for k, t in plain], "id int, w array<string>")
    if "*" not in str(query.alternatives):
        ranks = {r.id: r.s for r in shown.select("id", lexical.cover_rank(shown.w, query).alias("s")).collect()}
        for k, t in plain:
            assert round(ranks[k], 9) == round(brute(t, query) or 0, 9)
        both = {r.id: round(r.score, 9) for r in search.matched(shown, shown.w, query, "id").collect()}
        assert both == {k: round(s, 9) for k, t in plain if (s := brute(t, query)) is not None}


def test_web_queries_with_phrases():
    q = lexical.parse_web_query('"hot plastics" smell OR burning -"idling engines" the OR OR')
    assert q.alternatives == [["hot plastic", "smell"], ["burn"]] and q.absent == ["idl", "engin"]
    assert lexical.parse_web_query('"smoke of the fires"').alternatives == [["smoke * * fire"]] and lexical.parse_web_query("the").alternatives == []


def test_documents_without_text_or_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "of the"), (4, "Smoke, SMOKE!")], "id int, c string")
    query = lexical.parse_web_query("smoking")
    assert [(r.id, r.lexical_score, r["rank"]) for r in search.lexical_search(df, lexical.candidates("c", query), query, 5, "id").collect()] == [(4, 0.2, 1)]
    none = lexical.parse_web_query("the")
    assert search.matched(df, lexical.candidates("c", none), none, "id").collect() == []
    assert sorted(tuple(r) for r in lexical.postings(df, "id", "c").collect()) == [(4, 1, "smoke"), (4, 2, "smoke")]


def test_queries_run_with_stems():
    assert registry.WEB_QUERY.stemming and registry.PHRASE_QUERY.stemming
    assert any(" " in item for a in registry.PHRASE_QUERY.alternatives for item in a)
    assert re.search("tion", " ".join(registry.WEB_QUERY.words))
