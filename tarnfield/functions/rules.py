"""First-match rules as chained CASE expressions: page types, intents, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfield.functions.text import col, strip

# Page types by the wording of a title, first match wins.
PAGE_TYPES = (
    ("example", r"^(additional\s+)?examples?\b|\bexample\s+of\b"),
    ("launch", r"^launch\b"),
    ("overview", r"^(overview|introduction)\b"),
    ("statistical_details", r"^statistical\s+details\b"),
    ("reference", r"\b(functions?|operators?|messages|syntax reference)\b"),
    ("options", r"\boptions\b"),
    ("report", r"\breports?\b"),
    ("howto", r"^(create|add|import|export|save|use|set|change|edit|remove|delete|select|customize|configure|open|run|work with|manage|convert|copy|move|sort|filter|join|build|enter|view|show|hide|find|replace)\b"),
)
DEFAULT_TYPE = "concept"

# Intents by the wording of a question, first match wins. ``{script}`` is the name of the scripting language.
INTENTS = (
    ("scripting", r"\b({script}script|scripting|programmatic\w*|automate|automation|function\s+syntax|write\s+code|api|message|send\s*\(|add-?in)\b"),
    ("where_is_it", r"\b(where\s+(is|are|do|can)|which\s+menu|what\s+menu|find\s+the\s+(button|option|menu|setting)|how\s+do\s+i\s+get\s+to|located)\b"),
    ("option_lookup", r"\b(what\s+does\s+.*\s+(option|button|check\s*box|setting)|red\s+triangle|platform\s+options|what\s+is\s+the\s+.*\s+option|options?\s+(menu|available|list))\b"),
    ("troubleshoot", r"\b(why\s+(is|does|do|am|can'?t|won'?t)|error|fails?|failing|not\s+working|missing|blank|empty|grey(ed)?\s*out|disabled|unexpected|wrong|problem|troubleshoot)\b"),
    ("interpret", r"\b(interpret|meaning|what\s+does\s+.*\s+mean|how\s+do\s+i\s+read|understand\s+the\s+(output|report|result)|p-?value|significan\w*|how\s+is\s+.*\s+(computed|calculated)|formula\s+for|statistical\s+details)\b"),
    ("example", r"\b(example|walk\s*me\s*through|step\s*by\s*step|tutorial|demo|show\s+me\s+how|worked\s+example|sample\s+data)\b"),
    ("what_is", r"^\s*(what\s+is|what\s+are|what'?s|explain|describe|overview\s+of|tell\s+me\s+about|when\s+(should|would)\s+i\s+use|difference\s+between)\b"),
    ("how_to", r"\b(how\s+(do|can|would)\s+i|how\s+to|steps?\s+to|create|make|build|run|perform|generate|add|set\s+up|configure|import|export|save)\b"),
)
DEFAULT_INTENT = "how_to"

# How much an intent prefers a page type; pairs not named weigh 0.
WEIGHTS = {
    "how_to": {"launch": 1.0, "howto": 1.0, "example": 0.6, "concept": 0.45},
    "what_is": {"overview": 1.0, "concept": 0.8},
    "interpret": {"report": 1.0, "statistical_details": 0.8, "options": 0.3},
    "option_lookup": {"options": 1.0, "report": 0.5, "reference": 0.3},
    "example": {"example": 1.0, "howto": 0.4},
    "scripting": {"reference": 1.0, "concept": 0.2},
    "where_is_it": {"launch": 0.9, "howto": 0.7, "overview": 0.3},
    "troubleshoot": {"report": 0.5, "concept": 0.4, "statistical_details": 0.3},
}
# Greetings and questions about the assistant, follow-up words, and wording of model prose.
CHITCHAT = r"^\s*(hi|hey|hello|yo|thanks|thank you|ta|cheers|bye|goodbye|who are you|what can you do|what do you do|help)\b[\s!.?]*$"
FOLLOW_UP = r"\b(it|that|this|those|these|them|there|same|instead|also|what about|how about)\b"
PROSE = r"(the user|i need|i'?ll|let me|first,|okay|so they|this means|looking at|conversation|assistant)"


def first_match(text: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    out = None
    for name, pattern in rules:
        hit = text.rlike("(?iU)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def page_type(title: Column | str) -> Column:
    return first_match(strip(F.coalesce(col(title), F.lit(""))), PAGE_TYPES, DEFAULT_TYPE)


def intent_rules(script_name: str = "") -> tuple[tuple[str, str], ...]:
    return tuple((n, p.replace("{script}", script_name + "|" if script_name else "")) for n, p in INTENTS)


def intent(question: Column | str, script_name: str = "") -> Column:
    return first_match(strip(F.coalesce(col(question), F.lit(""))), intent_rules(script_name), DEFAULT_INTENT)


def prefers_scripting(intent_: Column) -> Column:
    return intent_ == "scripting"


def page_type_weight(intent_: Column | str, type_: Column | str) -> Column:
    flat = [F.lit(x) for i, ws in WEIGHTS.items() for t, w in ws.items() for x in (f"{i}/{t}", w)]
    return F.coalesce(F.try_element_at(F.create_map(*flat), F.concat(col(intent_), F.lit("/"), col(type_))), F.lit(0.0))


def route(question: Column | str) -> Column:
    """``chitchat`` needs no retrieval, ``docs`` does."""
    return F.when(strip(F.coalesce(col(question), F.lit(""))).rlike("(?iU)" + CHITCHAT), "chitchat").otherwise("docs")


def word_count(text: Column) -> Column:
    bare = strip(F.coalesce(text, F.lit("")))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+")))


def needs_expansion(question: Column, user_turns: Column) -> Column:
    """A follow-up in a conversation, or at most three words."""
    return ((user_turns > 1) & question.rlike("(?iU)" + FOLLOW_UP)) | (word_count(question) <= 3)


def looks_like_query(line: Column) -> Column:
    line = strip(line)
    n = F.length(line)
    ends = line.rlike(r"(\.|!|\?:)$")
    return (n > 3) & (n <= 90) & ~line.rlike("(?iU)" + PROSE) & (word_count(line) <= 14) & ~ends
