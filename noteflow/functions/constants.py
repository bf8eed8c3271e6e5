"""Limits, word lists and patterns that the results depend on."""

import re

# --- fixed values: kinds, topics and task names -----------------------------
NOTE_KIND = 1
RECORD_KIND = 9978
EVENTS_TOPIC = "nostr-events"
TASKS = {
    "nsfw": "nostr-nsfw-classification",
    "language": "nostr-language-classification",
    "toxicity": "nostr-hate-speech-classification",
    "sentiment": "nostr-sentiment-classification",
    "topic": "nostr-topic-classification",
}

# --- fixed values: limits and thresholds ------------------------------------
DEDUP_TTL_S = 300
FRESH_MINUTES = 10
TEXT_LIMIT = 350
NSFW_PROBABLE = 0.75
NSFW_HIGH = 0.85
ENGLISH_CONFIDENCE = 50.0
TOXIC_SCORE = 0.2
TOXIC_SUM_CAP = 0.99999999999
BACKFILL_PER_RELAY = 50
NOTE_DELAY_MS = 1000
SCORE_ATTEMPTS = 2
SCORE_PAUSE_S = 5.0
TOXICITY_LABELS = [
    "identity_attack", "insult", "obscene", "severe_toxicity",
    "sexual_explicit", "threat", "toxicity",
]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".webp"]
VIDEO_SUFFIXES = [".mp4", ".mov", ".wmv", ".webm", ".avi"]

# --- fixed values: text patterns --------------------------------------------
# White space as the note clients understand it; \s of Java and of RE2 is narrower.
SPACE = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
MENTION = (
    r"(?i)(nostr:)?@?(nsec1|npub1|nevent1|naddr1|note1|nprofile1|nrelay1)"
    r"([qpzry9x8gf2tvdw0s3jn54khce6mua7l]+)([\\\\S]*)"
)
ORDINAL = r"(?i)\d+(st|nd|rd|th)"
# The same matches in linear time: a number is tried once, from its first digit.
ORDINAL_LINEAR = r"(?i)(?<!\d)\d++(st|nd|rd|th)"
ZAP = r"(?i)(zaps?(athon)?)"
# Both cases are listed: (?i) makes the search for a run, the most frequent one, much slower.
HEX_RUN = r"(0[xX])?[0-9a-fA-F]{6,}"
PUNCT = r"([#*!?:(){}|\[\].,+\-_–—=<>%@&$~;/\\\t\r\n]|\d+|[【】「」（）。°•…])"
PUNCT_FULL = "([#*!?:(){}|\\[\\].,+\\-_–—=<>%@&$\"“”’'`~;/\\\\\\t\\r\\n]|\\d+|[【】「」（）。°•…])"
TOKEN_BREAK = r"""[""" + SPACE + r""",.!?;:(\[\]'"¡¿)/]+"""
# Every character of PUNCT and of TOKEN_BREAK; none lies beyond U+FFFF.
_BREAK = re.compile(re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", f"{PUNCT}|{TOKEN_BREAK}"), re.ASCII)
BREAKS = "".join(chr(c) for c in range(0x10000) if _BREAK.fullmatch(chr(c)))

# Obfuscated slurs and the one spelling each family is brought to.
SLUR_DELIMITER = r"""([""" + SPACE + r"""]|\.|,|\?|!|'|"|\(|\)|\[|\]|\{|\}|\z)"""
SLURS = [
    (r"(?i)(\w+)?(n(i|1|l|\||!)g{2,}(ay?|ers?|4|3rs?|uh))", "niggers "),
    (r"(?i)fags?" + SLUR_DELIMITER + r"|faggots", "faggot "),
    (r"(?i)cunts?" + SLUR_DELIMITER, "cunt "),
]
# The same matches in linear time: what stands before the slur in its word starts at the word's
# first character or where the last match ended.
SLURS_LINEAR = [(SLURS[0][0].replace(r"(\w+)?", r"(?:(?<!\w)|\G)(\w+)?", 1), SLURS[0][1]), *SLURS[1:]]

# What a text that a family matches has in it, in lower case.
SLUR_PARTS = [("nigg", "n1gg", "nlgg", "n|gg", "n!gg"), ("fag",), ("cunt",)]

GREETINGS = [
    ("gm", "good morning"),
    ("gn", "good night"),
    ("pv", "pura vida gratitude happy life"),
]

# Code points with the Unicode property Emoji, and the private use area.
EMOJI = (
    r"[\x{E000}-\x{F8FF}#*0-9\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}"
    r"\x{21A9}-\x{21AA}\x{231A}-\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}"
    r"\x{24C2}\x{25AA}-\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2604}\x{260E}"
    r"\x{2611}\x{2614}-\x{2615}\x{2618}\x{261D}\x{2620}\x{2622}-\x{2623}\x{2626}\x{262A}"
    r"\x{262E}-\x{262F}\x{2638}-\x{263A}\x{2640}\x{2642}\x{2648}-\x{2653}\x{265F}-\x{2660}"
    r"\x{2663}\x{2665}-\x{2666}\x{2668}\x{267B}\x{267E}-\x{267F}\x{2692}-\x{2697}\x{2699}"
    r"\x{269B}-\x{269C}\x{26A0}-\x{26A1}\x{26A7}\x{26AA}-\x{26AB}\x{26B0}-\x{26B1}"
    r"\x{26BD}-\x{26BE}\x{26C4}-\x{26C5}\x{26C8}\x{26CE}-\x{26CF}\x{26D1}\x{26D3}-\x{26D4}"
    r"\x{26E9}-\x{26EA}\x{26F0}-\x{26F5}\x{26F7}-\x{26FA}\x{26FD}\x{2702}\x{2705}"
    r"\x{2708}-\x{270D}\x{270F}\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}"
    r"\x{2733}-\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}"
    r"\x{2763}-\x{2764}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}-\x{2935}"
    r"\x{2B05}-\x{2B07}\x{2B1B}-\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}"
    r"\x{1F004}\x{1F0CF}\x{1F170}-\x{1F171}\x{1F17E}-\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}"
    r"\x{1F1E6}-\x{1F1FF}\x{1F201}-\x{1F202}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}"
    r"\x{1F250}-\x{1F251}\x{1F300}-\x{1F321}\x{1F324}-\x{1F393}\x{1F396}-\x{1F397}"
    r"\x{1F399}-\x{1F39B}\x{1F39E}-\x{1F3F0}\x{1F3F3}-\x{1F3F5}\x{1F3F7}-\x{1F4FD}"
    r"\x{1F4FF}-\x{1F53D}\x{1F549}-\x{1F54E}\x{1F550}-\x{1F567}\x{1F56F}-\x{1F570}"
    r"\x{1F573}-\x{1F57A}\x{1F587}\x{1F58A}-\x{1F58D}\x{1F590}\x{1F595}-\x{1F596}"
    r"\x{1F5A4}-\x{1F5A5}\x{1F5A8}\x{1F5B1}-\x{1F5B2}\x{1F5BC}\x{1F5C2}-\x{1F5C4}"
    r"\x{1F5D1}-\x{1F5D3}\x{1F5DC}-\x{1F5DE}\x{1F5E1}\x{1F5E3}\x{1F5E8}\x{1F5EF}\x{1F5F3}"
    r"\x{1F5FA}-\x{1F64F}\x{1F680}-\x{1F6C5}\x{1F6CB}-\x{1F6D2}\x{1F6D5}-\x{1F6D7}"
    r"\x{1F6DC}-\x{1F6E5}\x{1F6E9}\x{1F6EB}-\x{1F6EC}\x{1F6F0}\x{1F6F3}-\x{1F6FC}"
    r"\x{1F7E0}-\x{1F7EB}\x{1F7F0}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1F9FF}"
    r"\x{1FA70}-\x{1FA7C}\x{1FA80}-\x{1FA89}\x{1FA8F}-\x{1FAC6}\x{1FACE}-\x{1FADC}"
    r"\x{1FADF}-\x{1FAE9}\x{1FAF0}-\x{1FAF8}]"
)

# --- our own URL contract ---------------------------------------------------
# Scheme or "//", then an IPv4 address or a dotted host, then optional port and path.
# Quotes and ")" end a URL; trailing sentence punctuation is left out of it.
_URL_TAIL = r"""[^""" + SPACE + r"""\x{0085}"')]*[^""" + SPACE + r"""\x{0085}"').,;:!?]"""
_IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_AFTER_HOST = r"(?::\d{2,5})?(?:/(?:" + _URL_TAIL + r")?|[?#]" + _URL_TAIL + r")?"
URL = r"(?i)(?:[a-z]+:)?//(?:" + _IPV4 + r"|(?:[\p{L}\p{N}_-]+\.)+\p{L}{2,})" + _AFTER_HOST
# The same matches in linear time and without recursion. A scheme is tried once, from its first
# letter. Host labels are never given back one by one: a stretch of labels ends before one that
# begins with two letters, so the last stretch that was taken is where the host can end.
_LABEL = r"[\p{L}\p{N}_-]++\."
_HOST_LINEAR = rf"(?:{_LABEL}(?:(?!\p{{L}}{{2}}){_LABEL})*+(?=\p{{L}}{{2}}))++\p{{L}}{{2,}}"
URL_LINEAR = rf"(?i)(?:(?<![a-zA-Z])[a-z]++:)?//(?:{_IPV4}|{_HOST_LINEAR})" + _AFTER_HOST

# --- our own word lists for the default scorers ------------------------------
STOP_WORDS = {
    "de": "der die und von den sich mit zu das auf nicht im".split(),
    "en": "the and of to is that it was for with this are by".split(),
    "es": "el se y los del para las con su una por".split(),
    "fr": "et le les du pour une est qui par sur dans pas".split(),
}
TOXIC_WORDS = "trash clown scum idiot worthless moron pathetic loser disgusting stupid".split()
POSITIVE_WORDS = "good great love happy friends gratitude thanks nice beautiful win".split()
NEGATIVE_WORDS = "bad sad hate terrible awful angry worthless pathetic stupid lose".split()
TOPIC_WORDS = {
    "arts & culture & music": "art music song paint summit world".split(),
    "daily life": "morning night friends life coffee happy".split(),
    "business & money": "tip price market pay coin money".split(),
}
