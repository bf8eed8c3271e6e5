import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteflow.functions import text as T
from noteflow.functions.urls import extract_urls

GOLDEN = [
    (T.strip_mentions, "hi nostr:npub1qqpz9, x @note1acdefSS\\q", "hi  , x  q"),
    (T.strip_mentions, "NPUB1QQPZ9 and npub1 alone", "  and npub1 alone"),
    (T.strip_ordinals, "the 2nd 21street", "the  reet"),
    (T.squeeze_repeats, "coooool AaAa yess 777 hiii", "cool Aa yess 777 hii"),
    (T.squeeze_repeats, "cooool", "cool"),
    (T.split_camel_hashtags, "go #WorldSummit2 #fooBarBAZ #WorldSummitX fooBar #nope",
     "go #World Summit2 #foo BarBAZ #World SummitX fooBar #nope"),
    (T.split_camel_hashtags, "fooBar #" + "a" * 400 + "Bc", "fooBar #" + "a" * 400 + " Bc"),
    (T.normalize_slurs, "xn!ggers fags, fag", "niggers  faggot  faggot "),
    (T.normalize_slurs, "flags cunts\n", "flags cunt "),
    (T.replace_zap, "zaps zapathon zapping", "tip tip tipping"),
    (T.strip_hex, "0xdeadbeef decade abc", "    abc"),
    (T.strip_punct, "a,b 12 “c” d'e (f)…", "a b   “c” d'e  f  "),
    (T.tokenize_join, "hi, \"there\" don't (x)", "hi there don t x"),
    (T.normalize_text, "Été Über Ça ß", "ete uber ca ß"),
    (T.strip_punct_full, "don't “quote” `x` 12", "dont quote x "),
    (T.expand_greetings, "hello gm friends", "hellogood morning friends"),
    (T.expand_greetings, "gm all", "good morningall"),
    (T.expand_greetings, "my gmail", "mygood morningail"),
    (T.expand_greetings, "gn pv ", "good nightpura vida gratitude happy life"),
    (lambda c: T.expand_greetings(c, compat=False), "my gmail gm", "my gmail good morning"),
    (T.collapse_ws, " A\n\n b 　C ", "a b c"),
    (T.strip_emoji, "a😀b❤ 5 #*x", "ab  x"),
    (lambda c: T.truncate_text(c, 3), "abc", "abc"),
    (lambda c: T.truncate_text(c, 3), "abcd", "ab"),
    (lambda c: T.truncate_text(c, 3), "a😀bc", "a😀"),
    (lambda c: T.truncate_text(c, 0), "abcd", "abcd"),
]


def test_goldens(spark):
    # One job: each case is its own column of a one-row frame.
    row = spark.range(1).select(
        *[fn(F.lit(given_text)).alias(f"c{i}") for i, (fn, given_text, _) in enumerate(GOLDEN)]
    ).first()
    for i, (_, given_text, expected) in enumerate(GOLDEN):
        assert row[f"c{i}"] == expected, given_text


def test_strip_urls_leaves_the_rest_of_a_longer_url(spark):
    urls = F.array(F.lit("http://a.co"), F.lit("http://a.co/x"))
    got = spark.range(1).select(T.strip_urls(F.lit("p http://a.co/x q http://a.co"), urls)).first()[0]
    assert got == "p  /x q  "


def test_empty_text(apply):
    empty = lambda c: T.is_empty_text(c, extract_urls(c))
    assert apply(empty, [" \n ", "", " 　", "https://a.co/x", "x"]) == [
        True, True, True, False, False,
    ]


def test_fused_chain_equals_single_steps(apply):
    texts = [
        "gm", "“ gm", "gm “ x", "a — b—gm gn", "x  gm y", "  pv　", "a ́ gm", "; ; x",
        "don't “quote” soooo 2nd #CamelCase deadbeef00 https://a.co/x.jpg! zaps", "n1ggah fag", "#",
        "Ångström Å ά й ẞ İ ſ K", "tab\tnew\nline\x0b\x0c", "…•°", "`x` gm`", "gm gm gm", "12gn34",
        "a gm b", "", "   ", "😀 gm ❤️", "【gm】", "ZAPATHON Zap", "#gmGn #FooBar",
    ]
    pairs = apply(lambda c: F.struct(T.preprocess_text(c), T.chain_steps(c)), texts)
    for source, pair in zip(texts, pairs):
        assert pair[0] == pair[1], source


ALPHABET = "agmnpv GNZ#'\"“”`,.\n\t  　0159xé́—…😀/:@f"


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=200, max_size=400))
def test_fused_chain_on_random_texts(apply, texts):
    pairs = apply(lambda c: F.struct(T.preprocess_text(c), T.chain_steps(c)), texts)
    for source, pair in zip(texts, pairs):
        assert pair[0] == pair[1], repr(source)
        assert "  " not in pair[0] and not re.search("[A-Z0-9]", pair[0])


def test_language_input_is_cut(apply):
    got = apply(lambda c: T.language_input(c, 10), ["a😀" * 20, "short", "9 # x"])
    assert got == ["a" * 9, "short", "x"]
