"""Fixed values of the writing rules: word lists, limits and patterns."""

# --- fixed values: limits ---
WORDS_PROCEDURAL = 20
WORDS_DESCRIPTIVE = 25
SENTENCES_PARAGRAPH = 6
WORDS_CLUSTER = 3

# --- fixed values: word lists ---
FUNCTION_WORDS = (
    "a an the this that these those and or but if when then as of in on at to for from with without by into onto out up down over "
    "under above below before after during between through thru not no all each more less than is are was were be been will can must do "
    "does did you it its they them their we us there here also only because so same other"
).split()
DETERMINERS = (
    "the a an this that these those its their your each all no one two three four five six seven eight nine ten "
    "of in on at for with from to into and or between through thru"
).split()
CONTRACTIONS = (
    "can't won't don't doesn't didn't isn't aren't wasn't weren't it's that's there's you're we're they're i'm let's hasn't haven't "
    "hadn't shouldn't couldn't wouldn't mustn't"
).split()
BRITISH = {
    "colour": "color", "behaviour": "behavior", "labour": "labor", "neighbourhood": "neighborhood", "centre": "center", "metre": "meter",
    "litre": "liter", "fibre": "fiber", "analyse": "analyze", "organise": "organize", "organisation": "organization",
    "recognise": "recognize", "utilise": "utilize", "authorise": "authorize", "programme": "program", "catalogue": "catalog",
    "defence": "defense", "licence": "license", "practise": "practice", "travelled": "traveled", "cancelled": "canceled",
    "modelling": "modeling", "labelled": "labeled", "aluminium": "aluminum", "grey": "gray", "storey": "story",
    "judgement": "judgment", "acknowledgement": "acknowledgment",
}
SAFETY = ("warning", "caution", "danger", "attention", "notice")
PARTICLES = ("out", "up", "off", "down", "over", "away", "back", "on", "in")
COMMANDS = ("do", "make", "put", "install", "remove", "refer", "obey")
CONDITIONS = ("if", "when", "before", "after")
DESCRIPTION_OPENERS = ("the", "a", "an", "this", "it", "there")
RISK_PHRASES = (" because ", " to prevent ", " can cause ")
NOUN_LIKE = ("n", "adj")
CLOSED_CLASS = ("prep", "conj", "pron", "art")
ABBREVIATIONS = r"(?:No|Fig|Ref|approx|e\.g|i\.e|vs|Dr|Mr|Ms|St)"
VERB_SUFFIXES = (("ies", "y"), ("es", ""), ("es", "e"), ("s", ""), ("ed", ""), ("ed", "e"), ("d", ""), ("ing", ""), ("ing", "e"))
GERUND_SUFFIXES = (("ing", ""), ("ing", "e"), ("ying", "ie"))

# --- fixed values: patterns (Java) ---
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
FENCE = r"(?U)^\s*```"
TABLE_ROW = r"(?U)^\s*\|.*\|\s*$"
SEPARATOR = r"^[ :|\-]+$"
BLOCK = r"(?U)^\s*(?:#{1,6}|[-*+]|\d+[.)]|[A-Z][.)])\s+"
ITEM = r"(?U)^\s*(?:[-*+]|\d+[.)]|[A-Z][.)])\s+"
CODE, LINK, URL = "`[^`]*`", r"\[([^\]]*)\]\([^)]*\)", r"(?U)https?://\S+|www\.\S+"
TOKEN = "[A-Za-z][A-Za-z'’-]*"
PARENS, QUOTES = r"\([^)]*\)", '"[^"]*"'
NUMBER = r"(?U)\b\d[\d,.]*\s*[A-Za-z%$/]*\b"
EDGE = "'’-"
