"""Language markers, tool names and shell predicates, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of an annoyed operator, of a pleased one, and of a good ending.
NEGATIVE = (
    r"relitigat", r"whose money", r"why are (we|you)", r"that'?s not what", r"\bno\.\s*$", r"\bstop\b", r"\bwtf\b", r"wrong again", r"\bi said\b", r"you keep",
    r"hallucinat", r"not fun", r"\bbroken\b", r"don'?t do", r"\bagain\?", r"i didn'?t ask", r"burn(ing)? (money|tokens)", r"please don'?t", r"do not commit",
    r"stop reinforcing", r"don'?t feel like going (through|over)", r"we'?ve already done (it|this)", r"look in your memory", r"AI.?spla[in]", r"why restate",
    r"\bto be superior\b", r"i (already|just) (verified|gave|told|ran|showed)", r"run it all again", r"making more work for me",
)
POSITIVE = (
    r"thank", r"great work", r"good work", r"nice work", r"good job", r"good call", r"\bperfect\b", r"\bexcellent\b", r"\bfantastic\b", r"well done", r"\bexactly\b",
    r"nailed it", r"looks good", r"\blgtm\b", r"love it", r"\bawesome\b", r"\bbrilliant\b", r"much better", r"that works", r"that worked", r"\bbeautiful\b",
)
GOODBYE = r"thank|good\s*night|gnight|\bgn\b|handoff|great work|fantastic|excellent|well done|see you|sleep"
CLAIM = (
    r"\b(i|i'?ve|i'?m|i'?ll|let me|we|we'?ve)\b[^.!?\n]{0,40}?\b(done|logged|fixed|added|created|updated|removed|deleted|demoted|superseded|wrote|"
    r"saved|applied|committed|pushed|merged|renamed|installed|configured|verified|ran|checked|confirmed)\b"
)
ANNOUNCE = r"(i'?ll (run|do|check|read|write|edit|look)|let me (run|do|check|read|look|write|edit)|let'?s (run|check|look)|```)"
REDIRECT = r"(^|\b)(no\.?|that'?s not|that wasn'?t|i didn'?t|i did not|i wasn'?t|stop|actually|wait|you forgot|that'?s wrong|not what i|don'?t|that isn'?t|nope)\b"
#: Tools that only look, shell names, and shell commands that only look.
VERIFY_TOOLS = ("read", "grep", "glob", "code_recall", "code_status", "discover", "memory_recall", "lsp", "websearch", "webfetch", "toolsearch", "ls", "monitor")
SHELLS = ("bash", "shell", "run")
LOOKING = r"\b(cat|ls|head|tail|grep|rg|fd|find|stat|jj (st|status|log|diff|show)|git (st|status|log|diff|show)|--help|-h\b|sqlite3?.*\bselect\b|\bshow\b|\bstatus\b|\bdiff\b|\bwc\b|pwd|echo)\b"
#: Spellings of a tool's name that count as one.
TOOL_ALIASES = {"read": "read", "file_read": "read", "bash": "bash", "shell": "bash", "edit": "edit", "str_replace_editor": "edit", "write": "write", "grep": "grep", "rg": "grep", "glob": "glob", "webfetch": "web_fetch", "web_fetch": "web_fetch"}
#: Shell predicates.
DANGER = r"\brm\s+-[a-z]*r[a-z]*f|\brm\s+-[a-z]*f[a-z]*r|\bdd\s+.*\bof=|\bmkfs\b|:\(\)\s*\{"
FORCE = r"\b(git|jj)\b.*(push\s+.*(--force|-f)\b|reset\s+--hard|push\s+--force|branch\s+-D)"
HEREDOC = r"<<-?\s*['\"\\]?[A-Za-z_]"
CODE_HEREDOC = r"\b(python3?|node|deno|ruby|perl|php|jq|psql|sqlite3|Rscript)\b[^\n]{0,60}<<"
SHELL_WRITE = (
    r"(?<![0-9&])>{1,2}\s*(?!/dev/)(?!/tmp)(?!/var/tmp)(?!\$\{?TMP)(?!&)([~./][^\s&|;>]*|[A-Za-z][\w.-]*\.[A-Za-z][\w.]*)|\btee\s+(?!-)[^\s&|;>]"
)
READS, EDITS = ("read",), ("edit", "write", "multiedit", "notebookedit", "applypatch", "apply_patch")

ANY_CASE = "(?i)"


def one_of(markers: tuple[str, ...]) -> str:
    return ANY_CASE + "|".join(markers)


def marks(text: Column, markers: tuple[str, ...]) -> Column:
    """How often any of the markers occurs, without overlaps."""
    return F.regexp_count(text, F.lit(one_of(markers)))


def found_marks(text: Column, markers: tuple[str, ...]) -> Column:
    """The markers' matches, at most 24 characters of each."""
    return F.transform(F.regexp_extract_all(text, F.lit(one_of(markers)), F.lit(0)), lambda m: F.left(m, F.lit(24)))


def has(text: Column, pattern: str, any_case: bool = True) -> Column:
    return F.coalesce(text.rlike((ANY_CASE if any_case else "") + pattern), F.lit(False))


def ending(last: Column) -> Column:
    """How a session ends, from the last 400 characters of its last message."""
    tail = F.right(last, F.lit(400))
    ends = F.when(has(tail, GOODBYE), "signoff").when(has(tail, "|".join(NEGATIVE)), "ABRUPT+frustrated").otherwise("abrupt")
    return F.when(F.coalesce(last, F.lit("")) == "", "?").otherwise(ends)


def tool_of(name: Column) -> Column:
    """A tool's name in lower case, without a server's wrapper."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), "^mcp__.*__", ""))


def tool_family(name: Column) -> Column:
    """A tool's name with superficial spellings made one."""
    low = F.translate(F.lower(F.trim(F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name))), " -", "__")
    aliases = F.create_map(*[F.lit(x) for kv in TOOL_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(aliases, low), low)


def verifies(name: Column, command: Column) -> Column:
    """True for tools that look at results, and shells with a command that does."""
    t = tool_of(name)
    return t.isin(*VERIFY_TOOLS) | (t.isin(*SHELLS) & has(command, LOOKING))


def severity_rank(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s == "high", 0).when(s.isin("moderate", "medium", "med"), 1).when(s == "low", 2).otherwise(3)
