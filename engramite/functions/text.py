"""Text functions on columns: tokens, queries, hashes, names, scores. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that queries and word counts leave out.
STOPWORDS = (
    "help want need show tell find look please with for the a an and or but in on at to of is it are was were be been being have has had do does did "
    "will would could should may might shall can not no nor so if then than that this these those what which who whom how when where why all each every "
    "both few more most other some such only own same too very just about above after again also any because before below between by down during from "
    "further get got here into its let like make me my myself now off once our out over still there their them they through under until up upon use used "
    "using we well your you"
).split()

#: Patterns and weights of the dimensions of a learning's confidence.
SPECIFIC = [
    (r"\b[\w/]+\.\w{1,4}(?::\d+)?\b", 0.15), (r"\b(?:def|class|function|method)\s+\w+", 0.15), (r"\b[0-9a-f]{7,40}\b", 0.10), (r"`[^`]+`", 0.10),
    (r"\b(?:error|exception|traceback|typeerror|valueerror|keyerror)\b", 0.10), (r"\b(?:line \d+|column \d+)\b", 0.05), (r"(?:https?://|localhost:\d+)", 0.05),
]
ACTIONABLE = [
    (r"\b(?:use|always|never|must|should|prefer|avoid|ensure)\b", 0.20), (r"\b(?:instead of|rather than|don't|do not)\b", 0.15),
    (r"\b(?:works? (?:by|because|when)|the (?:fix|solution|approach) is)\b", 0.15), (r"\b(?:step \d|first|then|next|finally)\b", 0.10), (r"\b(?:pattern|technique|approach|strategy|workflow)\b", 0.10),
]
EVIDENT = [
    (r"\b(?:commit|merged|pr|pull request)\s*[#:]?\s*\w+", 0.20), (r"\b(?:tested|verified|confirmed|validated|proved)\b", 0.20), (r"\b(?:tests? pass|build succeed|works correctly)\b", 0.15),
    (r"\b\d+%|\b\d+/\d+\b", 0.10), (r"\b(?:benchmark|measured|profiled|timed)\b", 0.10),
]
VAGUE = [
    (r"\b(?:sometimes|perhaps|possibly)\b", 0.12), (r"\b(?:maybe|might)\b", 0.12), (r"\b(?:could|may)\b", 0.08), (r"\b(?:generally|usually|often|tends to)\b", 0.10),
    (r"\b(?:seems? to|appears? to|looks? like)\b", 0.10), (r"\b(?:in general|overall|broadly)\b", 0.10), (r"\b(?:etc|and so on|and more)\b", 0.05),
]


def words(text: Column) -> Column:
    """Lower case, hyphens apart, split on ASCII white space, letters and digits only, more than two characters, no stop words."""
    parts = F.split(F.regexp_replace(F.lower(text), "-", " "), r"[ \t\r\n\f\x0B]+")
    clean = F.transform(parts, lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.filter(clean, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def word_count(text: Column, word: str) -> Column:
    """How often ``words`` has a word (lower-case letters and digits, no stop word), without making the array: one regular expression that skips what cleaning removes."""
    blank, other = r" \t\r\n\f\x0B", r"[^a-z0-9 \t\r\n\f\x0B]*"
    pattern = f"(?<![^{blank}])" + other + "".join(c + other for c in word) + f"(?![^{blank}])"
    return F.regexp_count(F.replace(F.lower(text), F.lit("-"), F.lit(" ")), F.lit(pattern))


def query_words(query: str) -> list[str]:
    """Words of a query that full-text search takes: letters and digits, more than two characters, no stop words."""
    clean = ("".join(c for c in w if c.isascii() and c.isalnum()) for w in query.lower().replace("-", " ").split())
    return [w for w in clean if len(w) > 2 and w not in STOPWORDS]


def or_query(query: str) -> str:
    """Words joined by OR; empty when none is left, so that the caller skips the search."""
    return " | ".join(query_words(query))


def sanitized(words: Column) -> Column:
    """Letters and digits of each word, of those with more than two."""
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^a-zA-Z0-9]", "")), lambda w: F.length(w) > 2)


def cleaned_query(text: Column) -> Column:
    """Lower case, hyphens apart, no stop words; the text itself where nothing is left."""
    parts = F.filter(F.split(F.replace(F.lower(text), F.lit("-"), F.lit(" ")), r"[ \t\r\n\f\x0B]+"), lambda w: (w != "") & ~w.isin(STOPWORDS))
    return F.when(F.size(parts) == 0, text).otherwise(F.array_join(parts, " "))


#: Names of outcomes and what each is kept as.
OUTCOMES = {
    "SUCCESS": "SUCCEEDED", "SUCCEEDED": "SUCCEEDED", "PARTIAL": "PARTIAL_PLUS", "PARTIAL_PLUS": "PARTIAL_PLUS",
    "PARTIAL_MINUS": "PARTIAL_MINUS", "FAILED": "FAILED", "FAILURE": "FAILED", "UNKNOWN": "UNKNOWN",
}


def outcome(status: Column) -> Column:
    """The kept name of an outcome in any case; UNKNOWN for any other and for null."""
    named = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.upper(status)), F.lit("UNKNOWN"))


def core_matches(df: DataFrame, key: str, query: str) -> DataFrame:
    """Rows whose key holds the query or is held by it, in any case."""
    name, asked = F.lower(key), F.lit(query.lower())
    return df.where(F.contains(name, asked) | F.contains(asked, name))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(strip(text), 256)


def slug(text: Column, longest: int = 40, fallback: str = "untitled") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.regexp_replace(F.substring(made, 1, longest), "-+$", "")
    return F.when(short == "", F.lit(fallback)).otherwise(short)


def canonical_project(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Trimmed, lower case, without a home-folder prefix and outer slashes; aliases resolved; empty is null."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "^-users-[^-]+-", ""), "^/+|/+$", "")
    for old, new in (aliases or {}).items():
        low = F.when(low == old, F.lit(new)).otherwise(low)
    return F.when(low == "", F.lit(None)).otherwise(low)


def preview(text: Column, longest: int) -> Column:
    flat = F.regexp_replace(text, r"\s+", " ")
    return F.when(F.length(flat) > longest, F.concat(F.substring(flat, 1, longest), F.lit("..."))).otherwise(flat)


def tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda w: F.trim(w)), lambda w: w != "")


def dimension(text: Column, patterns: list[tuple[str, float]]) -> Column:
    """Sum of the weights of the patterns that occur, one at most."""
    total = F.lit(0.0)
    for pattern, weight in patterns:
        total = total + F.when(F.lower(text).rlike(pattern), F.lit(weight)).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def confidence(text: Column) -> Column:
    """high, medium or low, from how specific, actionable, evident and narrow a text is."""
    count = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    scope = F.greatest(F.least(0.7 - dimension(text, VAGUE) + F.when(count < 50, 0.1).when(count > 200, -0.1).otherwise(0.0), F.lit(1.0)), F.lit(0.0))
    score = 0.30 * dimension(text, SPECIFIC) + 0.25 * dimension(text, ACTIONABLE) + 0.25 * dimension(text, EVIDENT) + 0.20 * scope
    return F.when(score >= 0.30, "high").when(score >= 0.20, "medium").otherwise("low")


def chunks(text: Column, longest: int = 1200, overlap: int = 200) -> Column:
    """Overlapping windows of a stripped text; the last one stops where it reaches the end; none of an empty text."""
    whole, step = strip(text), longest - overlap
    last = F.greatest(F.ceil((F.length(whole) - overlap) / F.lit(step)) - 1, F.lit(0)).cast("int")
    starts = F.sequence(F.lit(0), last)
    return F.when(F.length(whole) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(whole, i * step + 1, F.lit(longest))))


def age(seconds: Column) -> Column:
    """2d ago, 3h ago, 5m ago, just now."""
    part = lambda n: F.floor(seconds / n).cast("string")
    return F.when(seconds >= 86400, F.concat(part(86400), F.lit("d ago"))).when(seconds >= 3600, F.concat(part(3600), F.lit("h ago"))).when(seconds >= 60, F.concat(part(60), F.lit("m ago"))).otherwise("just now")


def mask(secret: Column) -> Column:
    return F.when(F.length(secret) <= 8, "****").otherwise(F.concat(F.substring(secret, 1, 4), F.lit("****"), F.substring(secret, -4, 4)))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 of an empty text."""
    letters = F.split(text, "")
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters))
    return F.aggregate(counts, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def plain_html(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments and tags; a few entities resolved; white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


#: Phrases that tell of a change of view or of a confirmed approach.
SIGNALS = [
    r"\bactually\b", r"\brealized?\b", r"\bthe issue\b", r"\bthat'?s why\b", r"\bturns out\b", r"\bI was wrong\b", r"\bworks because\b", r"\bthe problem is\b", r"\bOh,", r"\bAha\b",
    r"\bnow I see\b", r"\bnow I understand\b", r"\bI see now\b", r"\bmisunderstood\b", r"\bwait,?\b", r"\bhmm\b", r"\binteresting\b", r"\bunexpected\b", r"\bsurpris", r"\bdifferent than\b",
    r"\bdifferent from\b", r"\bnot what I\b", r"\bwasn'?t\b.*\bexpect", r"\bthis works\b", r"\bthat works\b", r"\bworked well\b", r"\bgood approach\b", r"\bright approach\b", r"\bas expected\b",
    r"\bconfirm(?:s|ed)?\b.*\bapproach\b", r"\bthis pattern\b.*\b(?:works|effective|reliable)\b", r"\bkeep doing\b", r"\bcorrect approach\b", r"\bsolid approach\b",
    r"\bclean(?:er)? (?:solution|approach|pattern)\b", r"\beffective(?:ly)?\b.*\b(?:handles?|solves?|addresses)\b", r"\brobust\b.*\b(?:solution|approach|pattern)\b",
    r"\belegant\b.*\b(?:solution|approach|pattern)\b", r"\bthis is the right\b", r"\bvalidated\b",
]


def has_signal(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(SIGNALS))


def with_line(text: Column, line: str) -> Column:
    """The text with a line at its end, unless it has it."""
    return F.when(F.array_contains(F.split(text, "\n"), line), text).otherwise(F.concat(text, F.lit("\n" + line)))


def without_line(text: Column, line: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: x != line), "\n")


#: Commands are redacted by these rules in this order; the first group (and the second, if any) stays.
COMMAND_RULES = [
    (r"(?i)(Bearer\s+)\S+", "$1[REDACTED]"),
    (r"(://[^:]+:)[^@]+(@)", "$1[REDACTED]$2"),
    (r"(?i)(--(?:password|token|secret|key)=)(?:\"[^\"]*\"|'[^']*'|\S+)", "$1[REDACTED]"),
    (r"(?i)(--(?:password|token|secret|key)\s+)(?:\"[^\"]*\"|'[^']*'|[^\s-]\S*)", "$1[REDACTED]"),
    (r"(?i)((?:export\s+)?[A-Za-z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD|CREDENTIAL)[A-Za-z0-9_]*=)\S+", "$1[REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{8,}\b", "[REDACTED]"),
]

#: Free text is masked by these rules in this order.
SECRET_RULES = [
    (r"(?i)(Bearer\s+)\S+", "$1<redacted-secret>"),
    (r"(://[^:/@\s]+:)[^@\s]+(@)", "$1<redacted-secret>$2"),
    (r"(^|[^A-Za-z0-9_])((?:export\s+)?(?:[A-Z0-9]+_)*(?:KEY|SECRET|TOKEN|PASSWORD|CREDENTIALS?)=)\S+", "$1$2<redacted-secret>"),
    (r"\bsk-[A-Za-z0-9_-]{8,}", "<redacted-secret>"),
    (r"\bgh[opusr]_[A-Za-z0-9]{20,}", "<redacted-secret>"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}", "<redacted-secret>"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "<redacted-secret>"),
    (r"\b(?:pa|voy)-[A-Za-z0-9_-]{16,}", "<redacted-secret>"),
]

#: What of a database error is data: quoted literals, and the values of a key in a detail line.
VALUE_RULES = [(r"'[^']*'", "'<redacted>'"), (r"\)=\([^\n]*\)", ")=(<redacted>)")]


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules applied one after the other."""
    for pattern, kept in rules:
        text = F.regexp_replace(text, pattern, kept)
    return text


def log_field(text: Column, longest: int = 500) -> Column:
    """One line of printable ASCII and tabs for logs: other characters by number, longer texts cut with a mark, null named."""
    # the head is taken once: runs of plain characters as they are, any other one by itself
    pieces = F.regexp_extract_all(F.substring(text, 1, longest), F.lit(r"[\x20-\x7E\t]+|[^\x20-\x7E\t]"), F.lit(0))

    def shown(piece: Column) -> Column:
        code = F.ascii(piece)
        number = lambda prefix, width: F.concat(F.lit(prefix), F.lpad(F.lower(F.hex(code)), width, "0"))
        return F.when((code == 9) | code.between(32, 126), piece).when(code <= 0xFF, number("\\x", 2)).when(code <= 0xFFFF, number("\\u", 4)).otherwise(number("\\U", 8))

    line = F.array_join(F.transform(pieces, shown), "")
    cut = F.when(F.length(text) > longest, F.concat(F.lit("...[truncated "), F.length(text) - longest, F.lit(" characters]"))).otherwise("")
    return F.coalesce(F.concat(line, cut), F.lit("<none>"))


def file_mentions(text: Column) -> Column:
    """Files that a markdown text names: in back ticks with an extension (and an optional place), or after **File**:."""
    return F.concat(F.regexp_extract_all(text, F.lit(r"`([^`\n]+\.[a-z]+)(?::[^`\n]*)?`"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\*\*File\*\*:\s*`?([^\s`]+)`?"), F.lit(1)))


#: Phrases that say how something is asked, dropped in this order from a request.
ASKING = [
    r"(?i)^(can you|could you|would you|please|help me|i want to|i need to|let's|lets)\s+", r"(?i)^(show me|tell me|find|search for|look for|recall|remember)\s+",
    r"(?i)^(how do i|how can i|how to|what is|what are|where is|where are)\s+", r"(?i)\s+(for me|please|thanks|thank you)$", r"\?$",
]
#: Words that a request's keywords leave out.
PLAIN_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must can to of in for on with at by from as into through during "
    "before after above below between under again further then once here there when where why how all each few more most other some such no nor not only own same so than too very "
    "s t just don now i me my you your we help our they them their it its this that these what which who whom and but if or because until while about against also get got make "
    "want need look see use like know think take come go say said tell please let sure recall remember similar problems issues"
).split()


def keywords(text: Column, most: int = 5) -> Column:
    """The first distinct words of more than two characters that are not plain ones."""
    parts = F.split(F.regexp_replace(F.lower(text), r"[^\w\s-]", " "), r"\s+")
    return F.array_join(F.slice(F.array_distinct(F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(PLAIN_WORDS))), 1, most), " ")


def intent(text: Column) -> Column:
    """What is asked without how it is asked; the keywords where fewer than five characters are left."""
    kept = strip(replaced(strip(text), [(p, "") for p in ASKING]))
    return F.when(F.length(kept) < 5, keywords(text)).otherwise(kept)


#: Words that open a reply, and what follows in orders that only point at what was said.
LEADS = "no nope nah yes yeah yep yup ok okay sure nvm nevermind oops thanks exactly agreed cool great awesome perfect".split()
POINTING = (
    r"^(?:do|redo|undo|run|rerun|try|retry|repeat|revert|keep|continue|extend|fix|change|update|move|apply|test|save|delete|remove|show|add|create|make|use)\s+"
    r"(?:it|that|this|them|those|these)(?:\s+(?:again|now|once|more|instead|please|too|another\s+\d+(?:\s+\w+){1,2}))*$"
)
CHOOSING = (
    r"^(?:do|redo|run|rerun|try|retry|repeat|use|pick|choose|select|take|apply|keep)\s+the\s+(?:first|second|third|fourth|fifth|sixth|last|next|previous|prior|other|another|latter|former|same|top|bottom|\d+(?:st|nd|rd|th)?)"
    r"(?:\s+(?:one|ones|option|item|choice|approach|suggestion|result|match|idea|fix))?(?:\s+(?:again|now|please|instead|too))*$"
)


def is_conversational(text: Column) -> Column:
    """Short turns that need no recall: nothing, agreement, or an order that only points at what was said. Over eight words it is a request."""
    lead = "|".join(LEADS)
    low = F.regexp_replace(F.lower(strip(text)), rf"^({lead})\s*[,:;.-]+\s*", "$1 ")
    tokens = F.filter(F.transform(F.split(low, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\w]+|[^\w]+$", "")), lambda w: w != "")
    rest = F.array_join(F.when(F.get(tokens, F.lit(0)).isin(LEADS), F.slice(tokens, 2, 8)).otherwise(tokens), " ")
    return (F.size(tokens) == 0) | (F.size(tokens) <= 8) & (F.forall(tokens, lambda w: w.isin(LEADS)) | rest.rlike(POINTING) | rest.rlike(CHOOSING))
