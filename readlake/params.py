"""Parameter tables: word lists, thresholds and small dimensions of this library's own choosing, except where marked fixed."""

from __future__ import annotations

#: English function words left out of frequency counts.
STOP_WORDS = tuple(
    "the a an and or but nor not no of to in on at by for from with into over under through between about against during before after above below "
    "is are was were be been being am do does did has have had having can could will would shall should may might must "
    "i me my mine we us our ours you your yours he him his she her hers it its they them their theirs this that these those there here "
    "who whom whose which what when where why how all any both each few more most other some such only own same so than too very just also as if "
    "because while until then again once up down out off".split()
)
ABBREVIATIONS = tuple("mr mrs ms dr st prof vs etc fig no vol approx dept inc ltd".split())
ENGLISH_HINTS = tuple("the and of to in is that it for with as was be on this".split())
NEVER_NAMES = tuple(
    "The A An He She It They We You I This That These Those There Here And But Or Nor So Yet If When Then Now While What Which Who Whom Whose Why How Where "
    "In On At To Of By For From With As Into Over Under No Not Never Yes All Some Many Most Each Every Both Such His Her Its Their Our Your My Is Are Was Were Be".split()
)
ARTICLES = tuple("the a an his her its their our your my this that these those".split())
SPEECH_VERBS = tuple("said says asked answered added told shouted muttered remarked".split())
MOODS = (
    ("joyful", ("laugh", "smile", "delight", "merry", "cheer")),
    ("tense", ("danger", "alarm", "threat", "sudden", "nervous")),
    ("tender", ("gentle", "love", "kind", "dear", "embrace")),
    ("bleak", ("barren", "bitter", "despair", "ruin", "ash")),
    ("curious", ("strange", "puzzle", "secret", "question", "riddle")),
)
TIMES = (("night", ("nightfall", "asleep", "owl")), ("morning", ("daybreak", "breakfast", "cock")), ("noon", ("midday", "lunch")), ("evening", ("nightcap", "supper", "curfew")))
INSIDE = ("ceiling", "corridor", "cupboard", "bed", "desk", "carpet")
OUTSIDE = ("meadow", "harbour", "beach", "path", "cliff", "orchard")
#: Words that open a request and name nobody.
REQUESTS = tuple("Please Could Would Can Summarise Explain Define List Find Compare Translate Help Write Who What Make The A An".split())
#: What a question is about: the first pattern found in it decides.
INTENTS = (
    ("summary", "summar|recap|overview|in short"), ("cast", "who |character|persons"), ("theme", "theme|about|meaning|moral"), ("define", "define|vocabular|synonym|term"),
    ("explain", "explain|clarify|passage"), ("scene", "scene|film|picture|stage"),
)
#: Words that ask for long and for short drafts.
LONG_CUES = tuple("lengthy thorough in-depth multi-chapter saga long detailed unabridged".split())
SHORT_CUES = tuple("short quick tiny brief one-page snippet haiku".split())
WORDS_PER_MINUTE = 230  # fixed value
FINISHED = 99.5  # fixed value: progress that counts as finished
UPLOAD_LIMIT_MB = 25  # fixed value
#: File formats with their extensions and MIME types.
FORMATS = (
    ("pdf", ("pdf",), "application/pdf"),
    ("epub", ("epub",), "application/epub+zip"),
    ("docx", ("docx",), "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("pptx", ("pptx", "ppt"), "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ("markdown", ("md", "markdown"), "text/markdown"),
    ("txt", ("txt", "text"), "text/plain"),
    ("html", ("html", "htm"), "text/html"),
)
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
#: Cue words that make questions of conversation turns.
CUES = ("Please summarise: ", "Who is here: ", "What is the theme: ", "Define this word: ", "Explain the passage: ", "Make it a film: ", "")
#: Catalogue ranking: for each profile what a size of ten and a context of CONTEXT_CAP are worth.
CONTEXT_CAP = 131072
PROFILES = (("creative", 12.0, 6.0), ("fast", -4.0, 9.0))
#: profile, fragment of an id, bonus.
FAMILIES = (("creative", "widget", 5.0), ("creative", "red", 3.0), ("fast", "bolt", 4.0), ("fast", "small", 2.5), ("fast", "gear", -2.0))
#: What coders lose in every profile, and entries below TINY billions in some.
CODERS, CODER_LOSS = "(^|[-/])[a-z0-9_]*coder[a-z0-9_]*([-:]|$)", 120.0
TINY, TINY_LOSS = 7, {"creative": 20.0}
#: Makers by the pattern of their ids, and what being one of them is worth.
MAKERS = (("^brand-1[0-9]/", 2.0), ("^brand-[1-4]/", 1.0))


def sql_list(values) -> str:
    """A SQL list of strings."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
