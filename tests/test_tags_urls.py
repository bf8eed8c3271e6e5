from noteflow.functions import tags, urls
from noteflow.schema import TAGS


def test_hashtags(apply):
    rows = [[["t", "x"], [], ["e", "1"], ["t"]], [], [["T", "x"]]]
    assert apply(tags.extract_hashtags, rows, TAGS) == [["x", "undefined"], [], []]


def test_activitypub(apply):
    rows = [
        [["proxy", "u", "activitypub"]], [["proxy", "u", "activitypub", "z"]],
        [["proxy", "u", "ActivityPub"]], [[]], [],
    ]
    assert apply(tags.is_activitypub_user, rows, TAGS) == [True, False, False, False, False]


def test_root_post_and_warning(apply):
    rows = [[["e", "n"]], [["p", "n"], []], [], [["content-warning"]], [[None]]]
    assert apply(tags.is_root_post, rows, TAGS) == [False, True, True, True, True]
    assert apply(tags.has_content_warning, rows, TAGS) == [False, False, False, True, False]


def test_nsfw_hashtag(apply):
    assert apply(tags.has_nsfw_hashtag, [["NsFw"], ["nsfw2"], []], "array<string>") == [True, False, False]


def test_extract_urls(apply):
    texts = [
        "see https://a.co/x.jpg?w=1, (http://b.org) //c.net/y. http://localhost/x https://1.2.3.4:80/",
        "http://a.co http://a.co/x http://a.co", "none", "", "ftp://x.yz/w wss://r.example", "a//b",
    ]
    got = apply(urls.extract_urls, texts)
    assert got[0] == ["https://a.co/x.jpg?w=1", "http://b.org", "//c.net/y", "https://1.2.3.4:80/"]
    assert got[1] == ["http://a.co", "http://a.co/x"]
    assert got[4] == ["ftp://x.yz/w", "wss://r.example"]
    assert got[2] == got[3] == got[5] == []


def test_url_type(apply):
    given = [
        "http://a.com/x.JPG?b=1", "http://a.com/x.jpg#f", "http://localhost/x", "http://a.com/v.mp4",
        "http://a.com/?x=.png", "http://a.com/a.webp", "http://a.com/a.mp3",
    ]
    assert apply(urls.url_type, given) == ["image", "link", "unknown", "video", "link", "image", "link"]


def test_media_patterns(apply):
    patterns = [r"/^HTTPS:\/\/img\./gi", r"host\d+\.tld"]
    given = ["https://img.a.co/x", "http://host12.tld/y", "https://a.co/img.", "https://a.co/v.mov"]
    assert apply(lambda c: urls.matches_media_pattern(c, patterns), given) == [True, True, False, False]
    assert apply(lambda c: urls.media_urls(c, patterns), [given], "array<string>") == [
        [given[0], given[1], given[3]]
    ]
    assert apply(lambda c: urls.media_urls(c), [given], "array<string>") == [[given[3]]]


def test_clean_url(apply):
    given = ["http://a.com/x?y=1#z", "HTTP://A.com:80", "nope", "https://a.com:8443/p?q"]
    assert apply(urls.clean_url_without_params, given) == [
        "http://a.com/x#z", "http://a.com/", None, "https://a.com:8443/p",
    ]


def test_image_content_type(apply):
    assert apply(urls.is_image_content_type, ["image/png", "Image/png", "text/html"]) == [True, False, False]
