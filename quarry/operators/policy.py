"""Answers to policy questions as Column functions: what a question asks for is known, the text is a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T

# Trigger words of questions, patterns of texts and the sentences that stand for them.
HOME = ("wfh", "work from home")
CLOTHING = [
    r"ripped\s+clothing(?:\s+of\s+any\s+sort)?",
    r"low\s+cut\s+clothing(?:\s+such\s+as\s+jeans\s+and\s+t-shirts)?",
    r"casual\s+tops",
    r"track\s+suits?(?:\s*,?\s*including\s+pants\s+or\s+windcheaters)?",
    r"jeans",
    r"t-shirts",
    r"windcheaters",
    r"pants\s+or\s+windcheaters",
]
CLOTHING_NAMES = {
    "ripped clothing": "ripped clothing of any sort",
    "low cut clothing": "low cut clothing (such as jeans and T-shirts)",
    "casual tops": "casual tops",
    "track suit": "track suits (including pants and windcheaters)",
}
IN_TRACK_SUITS = ("jeans", "t-shirts", "windcheaters")
CLOCK = r"\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)"
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
OBLIGATIONS = ("must", "required", "should", "need to", "criteria", "eligible", "qualification")
OUTLINE = ("must", "required", "policy", "criteria", "designed to")
ROLE = {r"based\s+on.*role|role.*basis|position.*requirements": "• Role-based assessment required", r"suitable.*role|fit.*role|competency.*role": "• Must demonstrate role suitability and competency"}
PROBATION = {r"3\s+month.*probation|probation.*3\s+month": "• Must complete 3-month probationary period", r"completed.*probation|probation.*completed": "• Probationary period must be successfully completed"}
PERFORMANCE = {
    r"meeting.*expectations|exceeding.*expectations": "• Performance must meet or exceed expectations",
    r"consistent.*performance|performance.*consistent": "• Must maintain consistent performance record",
    r"individual.*performance": "• Individual performance will be evaluated",
}
ASPECTS = {"role": ("**Role Requirements:**", ROLE), "probation": ("**Probation Status:**", PROBATION), "performance": ("**Performance Requirements:**", PERFORMANCE)}
PROBATION_DONE, STEADY = r"completed?\s+(?:their\s+)?probation(?:ary)?\s+period", r"consistent\s+record\s+of\s+performance"
POSITIONS = r"not\s+all\s+positions?\s+(?:are\s+)?eligible|eligibility\s+depends\s+on.*role|role.*department.*job\s+responsibilities|position.*eligible.*wfh|specific\s+roles?\s+(?:are\s+)?eligible"
# Each sentence is due where all of its patterns match.
HOME_RULES = [
    ([POSITIONS, "not all positions"], "Not all positions are eligible for WFH. Eligibility depends on the employee's role, department, and job responsibilities."),
    ([PROBATION_DONE, STEADY], "Employees must have completed their probationary period and must have a consistent record of performance that meets or exceeds expectations."),
    (
        [r"case-by-case\s+basis|discretion\s+of.*manager.*hr|decisions\s+made\s+at.*discretion|evaluated.*case-by-case|manager.*hr.*approval"],
        "WFH eligibility is evaluated on a case-by-case basis, with decisions made at the discretion of the employee's manager and HR.",
    ),
    (
        [r"generally.*does\s+not\s+permit\s+wfh|company\s+does\s+not\s+permit.*except|not\s+permitted.*emergency\s+cases|proper\s+approval\s+and\s+process"],
        "Generally, the company does not permit WFH except in emergency cases, with proper approval and process.",
    ),
    (
        [r"remote\s+work\s+from\s+hometowns?\s+(?:is\s+)?not\s+permitted|connectivity\s+issues|avoid\s+miscommunication|hometowns?.*not\s+permitted"],
        "Remote work from hometowns is not permitted due to connectivity issues and to avoid miscommunication.",
    ),
]
HOME_SIMPLE = {
    PROBATION_DONE: "✓ Complete probationary period",
    STEADY: "✓ Maintain consistent performance meeting or exceeding expectations",
    r"company.*requirements|discretion": "✓ Subject to company requirements and management discretion",
}
HOME_HEAD = "**The eligibility criteria for Work From Home (WFH) at {company} are as follows:**\n\n"


def _asks(query: str, *words: str) -> bool:
    return any(w in query.lower() for w in words)


def _said(lower: Column, rules: dict[str, str]) -> Column:
    """The sentences whose pattern matches, in order."""
    return F.array_compact(F.array(*[F.when(lower.rlike(p), F.lit(s)) for p, s in rules.items()]))


def _listed(head: str, items: Column) -> Column:
    """Null where there is no item."""
    return T.bound(items, lambda x: F.when(F.size(x) > 0, F.concat(F.lit(head), F.array_join(x, "\n"))))


def prohibited(text: Column) -> Column:
    """Up to four kinds of clothing that a text names, each under its usual name."""
    lower = F.lower(text)
    found = F.flatten(F.array(*[F.regexp_extract_all(lower, F.lit(p), F.lit(0)) for p in CLOTHING]))
    distinct = F.array_distinct(F.transform(found, lambda x: F.rtrim(F.regexp_replace(x, r",+\z", ""))))

    def step(out: Column, item: Column) -> Column:
        name = item
        for part, usual in reversed(CLOTHING_NAMES.items()):
            name = F.when(F.contains(item, F.lit(part)), F.lit(usual)).otherwise(name)
        usual = F.array(*[F.lit(n) for n in CLOTHING_NAMES.values()])
        covered = item.isin(*IN_TRACK_SUITS) & F.exists(out, lambda x: F.contains(x, F.lit("track suit")))
        again = ~F.array_contains(usual, name) & F.array_contains(out, name)
        return F.when(covered | again, out).otherwise(F.array_append(out, name))

    return F.slice(F.aggregate(distinct, F.array().cast("array<string>"), step), 1, 4)


def prohibition(text: Column) -> Column:
    """One sentence; null where nothing is named."""

    def sentence(x: Column) -> Column:
        n = F.size(x)
        last = F.element_at(x, -1)
        several = F.concat(F.array_join(F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), last)
        listed = F.when(n == 1, last).when(n == 2, F.concat(F.get(x, F.lit(0)), F.lit(" and "), last)).otherwise(several)
        return F.when(n > 0, F.concat(F.lit("The dress code prohibits "), listed, F.lit(".")))

    return T.bound(prohibited(text), sentence)


def hours(text: Column) -> Column:
    """All clock times and days of a text as one sentence, days in order of the week; a text without times as it is."""
    times = F.transform(F.regexp_extract_all(text, F.lit(CLOCK), F.lit(0)), F.upper)
    days = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){d}"), F.lit(d)) for d in DAYS]))
    on = F.when(F.size(days) > 0, F.concat(F.lit(" on "), F.array_join(days, ", "))).otherwise("")
    return T.bound(times, lambda t: F.when(F.size(t) == 0, text).otherwise(F.concat(F.lit("Working hours are "), F.array_join(t, " to "), on, F.lit("."))))


def _named(text: Column, words: tuple[str, ...], least: int, most: int, tidy: bool) -> Column:
    sentences = F.filter(T.sentences(text), lambda s: F.length(s) >= least)
    picked = F.filter(sentences, lambda s: F.lower(s).rlike("|".join(words)))
    if tidy:
        picked = F.filter(F.transform(picked, lambda s: F.regexp_replace(s, "^[^a-zA-Z]*", "")), lambda s: F.length(s) > 15)
    return F.slice(F.transform(picked, lambda s: F.concat(F.lit("• "), s)), 1, most)


def home_policy(text: Column, company: str = "the company") -> Column:
    """Numbered rules on work from home; the short list where none is found; null without either."""
    lower = F.lower(text)

    def due(patterns: list[str]) -> Column:
        every = F.lit(True)
        for p in patterns:
            every = every & lower.rlike(p)
        return every

    rules = F.array_compact(F.array(*[F.when(due(p), F.lit(s)) for p, s in HOME_RULES]))
    numbered = F.transform(rules, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return F.coalesce(_listed(HOME_HEAD.format(company=company), numbered), home_simple(text))


def home_simple(text: Column) -> Column:
    return _listed("**WFH Eligibility Criteria:**\n\n", _said(F.lower(text), HOME_SIMPLE))


def eligibility(text: Column, query: str, company: str = "the company") -> Column:
    """Up to four sentences on obligations; of work from home its policy."""
    if _asks(query, *HOME):
        return home_policy(text, company)
    return _listed("**Eligibility Criteria:**\n\n", _named(text, OBLIGATIONS, 10, 4, True))


def outline(text: Column, query: str) -> Column:
    """The aspects of work from home that are asked for, else up to three key points."""
    points = _listed("**Key Points:**\n\n", _named(text, OUTLINE, 20, 3, False))
    if not _asks(query, *HOME):
        return points
    parts = F.array_compact(F.array(*[_listed(head + "\n", _said(F.lower(text), rules)) for aspect, (head, rules) in ASPECTS.items() if _asks(query, aspect)], F.lit(None).cast("string")))
    return F.coalesce(T.bound(parts, lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n\n"))), points)


def formatted(text: Column, query: str, company: str = "the company") -> Column:
    """The first form that the question asks for and the text has; else the text in plainer words."""
    forms = []
    if _asks(query, "prohibit") and _asks(query, "dress code", "clothing"):
        forms.append(prohibition(text))
    if _asks(query, "hours"):
        forms.append(F.when(text != "", hours(text)))
    if _asks(query, "eligibility", "criteria", "requirements", "eligible"):
        forms.append(eligibility(text, query, company))
    if _asks(query, "outline", "summarize", "list", "what are"):
        forms.append(outline(text, query))
    return F.coalesce(*forms, T.clean_policy(text))
