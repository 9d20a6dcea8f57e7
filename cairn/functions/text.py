"""Column functions on text: tokenisers, links, screening patterns, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
# Tokens keep inner signs, and their parts count as tokens too.
TOKEN = r"[a-z0-9]+(?:[-_./:][a-z0-9]+)*"
INNER = r"[-_./:]"
LINK = r"\[\[([^\]]+)\]\]"

# Patterns of texts that look like secrets (one alternation).
SECRET = (
    r"(?i)((?:mnemonic|seed[_-]?phrase|recovery[_-]?phrase)\s*[:=]\s*(?:[a-z]+[\s,]+){5,}[a-z]+"
    r"|(?:client[_-]?secret|webhook[_-]?secret|api[_-]?key|apikey|password|passwd|secret|token|access[_-]?token|mnemonic|seed[_-]?phrase|recovery[_-]?phrase|private[_-]?key|priv[_-]?key|macaroon)\s*[:=]\s*['\x22]?[^\s'\x22]{6,}"
    r"|originSessionId\s*[:=]?\s*[0-9a-fA-F-]{8,}"
    r"|-----BEGIN[ A-Z]*PRIVATE KEY"
    r"|Bearer\s+[A-Za-z0-9._\-]{20,}"
    r"|xprv[a-zA-Z0-9]{20,}"
    r"|\b[5KL][1-9A-HJ-NP-Za-km-z]{50,51}\b"
    r"|AKIA[0-9A-Z]{16}"
    r"|gh[pousr]_[A-Za-z0-9]{20,}"
    r"|sk-[A-Za-z0-9_-]{20,}"
    r"|[0-9a-f]{32,}"
    r"|[A-Za-z0-9+/]{40,}={0,2})"
)
MASK = "«redacted-secret»"
# Fixed value: the narrower pattern that stops a write; it leaves bare hashes alone.
GUARD = (
    r"(?i)((?:mnemonic|seed[_-]?phrase|recovery[_-]?phrase)[ \t]*[:=][ \t]*(?:[a-z]+[ \t,]+){5,}[a-z]+"
    r"|(?:client[_-]?secret|webhook[_-]?secret|api[_-]?key|apikey|password|passwd|secret|token|access[_-]?token|mnemonic|seed[_-]?phrase|recovery[_-]?phrase|private[_-]?key|priv[_-]?key|macaroon)[ \t]*[:=][ \t]*.?[A-Za-z0-9_/+-]{8,}"
    r"|BEGIN[ \t]+[A-Z ]*PRIVATE KEY|-----BEGIN[ \t]|Bearer[ \t]+[A-Za-z0-9._-]{20,}|xprv[a-zA-Z0-9]{20,}|[5KL][1-9A-HJ-NP-Za-km-z]{50,51}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|[0-9a-f]{80,})"
)

# Signs of planted instructions, the first that matches gives the tag.
DENIED = [
    ("pipe-to-shell", r"(?i)\b(curl|wget|fetch)\b[^\n]*\|\s*(bash|sh|zsh|python\d?)\b"),
    ("pipe-to-shell", r"(?i)\|\s*(bash|sh|zsh)\b\s*$"),
    ("code-exec", r"(?i)\b(eval|exec|os\.system|subprocess\.|child_process|shell_exec)\s*\("),
    ("network-callback", r"(?i)(/dev/tcp/|\bnetcat\b|\bnc\s+-e\b|reverse shell|bash\s+-i\b)"),
    ("secret-file-exfil", r"(?i)\b(cat|read|scp|curl|upload|send|post|exfiltrat\w*)\b[^\n]{0,60}(id_rsa|id_ed25519|\.ssh/|\.env\b|\.macaroon\b|wallet\.dat|/etc/shadow)"),
    ("key-material-exfil", r"(?i)\b(seed phrase|mnemonic|private key|secret key)\b[^\n]{0,40}\b(send|post|upload|share|reveal|print)\b"),
    ("prompt-override", r"(?i)\b(ignore|disregard|override|forget) (previous|prior|above|all|earlier)\b"),
    ("instruction-planting", r"(?i)\byou (must|must always|should always|are required to)\b"),
    ("persist-instruction", r"(?i)\b(always (run|execute)|from now on|on every (session|startup|prompt))\b"),
    ("system-prompt-ref", r"(?i)\bsystem prompt\b"),
    ("verdict-injection", r"(?i)VERDICT:\s*(SAFE|SUSPECT)"),
]
# Words of passing states.
TRANSIENT = r"(?i)\b(status|listening|reachable|uptime|running|healthy|health[- ]?check|state[- ]?check|final[- ]?state|recreat(?:e|ed|ion)|restarted|confirmation|is up)\b"
# Classes of hard facts; \b stands for an ASCII word border in all of them.
FACTS = [
    ("port", r":\d{2,5}\b"),
    ("port", r"\bport\s+\d{2,5}\b"),
    ("ip", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("path", r"/(?:home|data|root|usr|etc|var|opt)/[A-Za-z0-9_./\-]+"),
    ("env", r"\b[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)+\b"),
    ("commit", r"\bcommit\s+`?[0-9a-f]{7,40}`?"),
    ("file", r"\b[A-Za-z0-9_\-]+\.(?:py|ts|js|tsx|toml|env|sh|service)\b"),
    ("amount", r"\b\d+\.\d+\s*(?:BTC|L-BTC|sats?|USDt?|USDC)\b"),
    ("threshold", r"(?:THRESHOLD|=|version|toolchain|pinned to)\s*`?\d+\.\d+`?"),
]
# Numbers that say nothing; words that are no keywords; signs of a text that wants to stay.
FACT_STOP = ["0.0", "1.0", "2.0", "3.0"]
STOPWORDS = "the a an and or of to in on for with from this that into via per project reference feedback memory notes setup config server fixed using used new old overhaul status known issues deployment".split()
PERSIST = (
    r"(?i)\balways (remember|run|use|do|apply|execute)\b|\bnever (forget|delete|remove|change)\b|\bremember (this|that|to|always)\b|\bdo not (delete|remove|forget|change) (this|the)\b|\bpersist(ent|ence)?\b"
    r"|\bimportant\b[^.]{0,40}\bremember\b|\b(ignore|disregard|override) (previous|prior|above|all)\b|\byou (must|must always|should always|are required to)\b|\bsystem prompt\b|\bfrom now on\b"
)



def ascii_border(pattern: str) -> str:
    r"""Java's \b follows Unicode; this makes it the ASCII border that other engines have."""
    return pattern.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def matches(text: Column | str, pattern: str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(ascii_border(pattern))


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; those with inner signs are followed by their parts. Null gives an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(found, lambda x: F.when(x.rlike(INNER), F.concat(F.array(x), F.filter(F.split(x, INNER), lambda p: p != ""))).otherwise(F.array(x))))


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits, _ and - of more than one byte, lower-cased."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_-]+")
    return F.transform(F.filter(parts, lambda x: F.octet_length(x) > 1), lambda x: F.lower(x))


def links(text: Column) -> Column:
    """Distinct wiki links, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINK), F.lit(1))))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, MASK)


def deny_tag(text: Column | str) -> Column:
    """Tag of the first pattern that matches, or null."""
    out = None
    for tag, pattern in DENIED:
        out = F.when(matches(text, pattern), tag) if out is None else out.when(matches(text, pattern), tag)
    return out


def canonical_body(text: Column) -> Column:
    """Without leading frontmatter, provenance lines, trailing blanks and empty lines."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A---\n(?s:.*?)\n---\n", "")
    lines = F.transform(F.split(F.replace(bare, F.lit("\r"), F.lit("")), "\n"), lambda x: F.rtrim(x))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("> provenance:")), "\n")


def norm_text(text: Column) -> Column:
    """Lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\r\n]+", " "))


def graph_tokens(text: Column) -> Column:
    """Up to 32 words of at least 4 bytes, split at anything but letters, digits, _ and -; each once whatever its case, first spelling kept."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_-]+"), lambda x: F.octet_length(x) >= 4)
    low = F.transform(words, lambda x: F.lower(x))
    return F.slice(F.filter(words, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, 32)


def sentences(text: Column) -> Column:
    """Sentences of at least 25 characters: paragraphs with single blanks, cut after . ! ? and without list marks in front."""
    flat = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n[ \t\r\n]*\n"), lambda p: F.trim(F.regexp_replace(p, r"[ \t\r\n]+", " ")))
    cut = F.flatten(F.transform(flat, lambda p: F.split(F.regexp_replace(p, r"([.!?]) +", "$1\n"), "\n")))
    bare = F.transform(cut, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-*# ]+", "")))
    return F.filter(bare, lambda x: F.length(x) >= 25)


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def shortened(text: Column, width: int = 60) -> Column:
    """Single blanks, and at most ``width`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) > width, F.concat(F.rtrim(F.substring(flat, 1, width - 1)), F.lit("…"))).otherwise(flat)
