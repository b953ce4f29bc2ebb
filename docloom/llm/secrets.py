"""Credentials in source code and configuration: where each begins, and the text with them redacted.

Candidates are quoted strings, assigned values and long tokens. Each gets the Shannon entropy of its
alphabet (hexadecimal, alphanumeric, base64, printable), which must exceed a threshold adjusted to its
length: a short string cannot reach the entropy of a long one. What stands around a candidate moves the
bar: a name such as ``password`` lowers it, a name such as ``checksum`` or a path rules it out. Formats
that issuers use (fixed prefixes, key blocks, signed tokens) and URLs or headers that carry a credential
are recognised as such. Hashes, identifiers, placeholders and references to variables are left out.

Redaction replaces the credential's characters only; quotes, separators and everything else stay, so code
keeps its shape. A key block is replaced between its first and last line, which stay.

Defined cases: null and empty texts have no finding and are returned as they are; repeated rows have the
same findings; lines are counted over line feeds from 1, a header line included.
"""

from __future__ import annotations

import base64
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrow import batch, map_batches
from docloom.session import spread, table

MASK = "[REDACTED]"

# Formats of issued tokens.
FORMATS = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_\-]{18,}|xox[abeoprs]-[A-Za-z0-9\-]{10,}|[spr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[A-Za-z0-9_\-]{33,37}|npm_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|ey[JI][A-Za-z0-9_\-]{8,}\.ey[JI][A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{10,}"
    r"|dop_v1_[a-f0-9]{40,}|pypi-[A-Za-z0-9_\-]{30,}|hf_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_\-]{24,}|ya29\.[A-Za-z0-9_\-]{20,})"
)
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]{1,20}://([^\s:/@\"'`<>]*):([^\s@\"'`<>]+)@(?=[A-Za-z0-9\[])")
HEADER = re.compile(r"(?i)\b(?:proxy-)?authorization[\"']?\s*[:=]\s*[\"']?(?:bearer|basic|token|digest)\s+([^\s\"'`,;]+)|\b(?:x-[a-z\-]{0,40}(?:key|token|secret|auth)|private-token|api-key)[\"']?\s*:\s*[\"']?([^\s\"'`,;]+)")
BEARER = re.compile(r"(?i)[\"'`\s]bearer\s+([A-Za-z0-9._~+/\-]{16,}=*)")
EMPTIED = re.compile(r"\s*" + re.escape(MASK) + r"\s*-----END ")
IDENTIFIED = re.compile(r"\bIDENTIFIED\s+(?:WITH\s+\w+\s+)?(?:BY|AS)\s+(?:PASSWORD\s+)?['\"]([^'\"\n]+)['\"]", re.I)
# Commands and their options that take a credential without naming it.
GIVEN = {
    "curl": re.compile(r"\s(?:-u|--user)[ =]?[\"']?[^\s:\"']+:([^\s\"']+)"),
    "wget": re.compile(r"\s--(?:http-|ftp-)?password[ =][\"']?([^\s\"']+)"),
    "mysql": re.compile(r"\s-p[\"']?([^\s\"']+)"),
    "sshpass": re.compile(r"\s-p\s*[\"']?([^\s\"']+)"),
    "redis-cli": re.compile(r"\s(?:-a|--pass)\s+[\"']?([^\s\"']+)"),
}
COMMANDS = {w: re.compile(rf"\b{w}\w*\b" if w == "mysql" else rf"\b{w}\b") for w in GIVEN}
# Words that name a credential, and endings that make the name that of something else.
STEMS = [re.compile(x) for x in ("pass", "pwd", "pw", "secret", "token", "key", "credential", "auth", "kennwort", "contrase", "senha", "парол", "密码", "パスワード")]
OTHER_LANGUAGES = re.compile(r"(?i)(?:passwort|kennwort|contrase(?:ñ|n)a|senha|mot_?de_?passe|пароль|密码|パスワード)$")
FINAL = {"pass", "password", "passwd", "passphrase", "passcode", "pw", "pwd", "secret", "token", "credential", "credentials", "apikey", "auth"}
FINAL_KEYS = {"api", "access", "secret", "signing", "encryption", "private", "service", "master", "auth", "shared", "account", "storage", "license", "session", "client", "admin", "hmac", "ssh"}
JOINED = re.compile(r"(?:password|passwd|passphrase|passcode|dbpass|smtppass|userpass|adminpass|rootpass|pwd|secret|token|apikey|accesskey|secretkey|signingkey|encryptionkey|privatekey|servicekey|authkey|masterkey|credentials?)$")
STRONG = re.compile(r"(?i)pass|pw|kennwort|contrase|senha|пароль|密码|パスワード|secret|credential|api_?key|apikey|(?:access|signing|encryption|private|service)_?key")
SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# Stand-ins for a credential.
PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|-{3,}|_{3,}|todo|fixme|tbd|none|null|nil|true|false|undefined|changeme|change[_-]?me|change[_-]?it|replace[_-]?me|insert[_-]?here|example|sample|dummy|placeholder|redacted|\[redacted\]|masked|hidden|secret|password|passwd|test|foo|bar|foobar|letmein|empty|unset|n/?a|string|str)$"
    r"|your[_\- ]|[_\- ]here$|replace|example|placeholder|redacted|changeme|dummy|^<.*>$|^\[.*\]$|^%\w+%$|^%\(|^#\{|^@\w+@$|^\{\{|x{6,}|\*{4,}"
)
REFERENCE = re.compile(r"^\$\w+$|^\$[A-Z_]{3,}|^\{\{|\$\{|\$\(|\{\{|^<%|^env[.:(]|^ENC\[|^vault:|^secret:|^arn:|^projects/|^ref\+|^!(?:vault|reference|secret|Ref|Sub|ENV|env|include)|^op://|^ssm:|^(?:os|process|System|config|settings|var|local|data|module|secrets?|vault|self|this|ctx|env|cfg|opts|options|args|params|request|req|props)[.\[(]")
PATHLIKE = re.compile(r"^(?:~|\.{0,2})?/|^[A-Za-z]:\\|^[\w\-.]+(?:/[\w\-.]+)+\.\w{1,5}$|^https?://|\.(?:pem|pub|crt|cer|key|jks|p12|pfx|txt|json|ya?ml|toml|env|conf|cfg|md|html?|go|py|js|ts|java|sql|rb)$")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
HASH = re.compile(r"(?i)^(?:sha(?:1|256|384|512)|md5|h1|crc32)[:\-]|^\$2[aby]\$|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$")
HEX = re.compile(r"^[0-9a-fA-F]+$")
IDENT = re.compile(r"^(?:[a-z]+(?:[A-Z][a-z]+)*|[A-Z][a-z]+(?:[A-Z][a-z]+)*|[a-z]+(?:[_\-.][a-z]+)*|[A-Z]+(?:_[A-Z]+)*|[A-Z][a-z]+(?:[-_ ][A-Z]?[a-z]+)*)[()]*$")
LITERAL = re.compile(r"([\"'`])((?:\\.|(?!\1)[^\\\n])*)\1")
CONCAT = re.compile(r"[ \t]*[+.\\]?[ \t]*\r?\n?[ \t]*[+.]?[ \t]*(?=[\"'])")
DECODER = re.compile(r"(?:[\w.]*(?:b64decode|atob|decode|decodeString|DecodeString|fromBase64|base64Decode|from_base64|unhex|fromhex|bytes|Buffer\.from|String|new String)\s*\(\s*)+(?=[\"'])", re.I)
PROSE = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase)?|pwd|pw|secret|token|credentials?)\b")
CALL = re.compile(r"\w*[ \t]*\(")
CALLED = [re.compile(x) for x in ("connect", "dial", "login", "log_in", "logon", "signin", "sign_in", "auth", "open", "bind", "initclient", "init_client", "create_engine")]
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What is said about a password stands in the same sentence or clause, or this near.
NEAR = 200
CLAUSE_END = re.compile(r"[.!?](?=[\s\"'`)]|$)|[;{}。！？]|\\[nrt]|[\"'](?=[ \t]*[,:\])}])|[\[(,:][ \t]*(?=[\"'])")
SCAN = re.compile(r"\\.|([\"'`])((?:\\.|(?!\1)[^\\\n])*)\1|[()]")
TOKENS = re.compile(r"[^\s\"'`<>()\[\]{},]+")
#: Candidates under any name or none: quoted strings without blanks, and runs of the characters that keys are written in.
QUOTED = re.compile(r"([\"'`])([!#-&*-+\--9=?-Z^_a-z~]{16,})\1")
LONG = re.compile(r"[A-Za-z0-9+/_\-.~]{16,}={0,2}")
KINDS = str.maketrans("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
#: A longer string that no name calls a credential is encoded data, unless it decodes to a private key.
DATA_FROM, WRAPPED_AT = 257, 64
# Endings of names that say how a value is written; words that suit a credential; last words of names of other random values.
ENCODED = {"b", "base", "enc", "encoded", "data"}
HINT = re.compile(r"(?i)hmac|seed|salt|secret|cred|pass|pwd|token|auth|(?:private|signing|encryption|client|access|api|master)[_\-.]?key")
NOT_SECRET = re.compile(
    r"(?i)(?:hash|digest|checksum|crc|sha\d*|md5|sum|integrity|etag|fingerprint|thumbprint|commit|rev|revision|ref|uuid|guid|ids?|cert(?:ificate)?|ca|public|pub|public[_\-.]?key|cursor|sig|signature|version|url|uri|path|file|name|image|icon|font|src|href|trace|span|request|build|mappings)$"
)
NAME_BEFORE = re.compile(r"([A-Za-z_][\w.\-]*)(?:[\"'`\])]*[ \t]*(?::=|=>|=|:)[ \t]*(?:[\w.]*\([ \t]*)?[bru]?[\"'`]?|>[ \t]*)$")
DIGEST_BEFORE = re.compile(r"(?i)(?:\b(?:sha\d+|md5|h1|crc32)[:\-]|base64,|\b(?:ssh-\w+|ecdsa-sha2-\w+)[ \t]+)$")
ADDRESS_BEFORE = re.compile(r"://[^\s\"'`]*$")
PUBLIC_BLOCK = re.compile(r"-----BEGIN (?![A-Z0-9 ]*PRIVATE)[A-Z0-9 ]+-----[^\-]*(?:-----END [A-Z0-9 ]+-----)?")


def alphabet(value: str) -> tuple[str, float]:
    """The smallest usual alphabet that holds the value, and the bits per character that it allows."""
    if HEX.match(value) and not value.isdigit():
        return "hex", 4.0
    if value.isalnum():
        return "alnum", 5.95
    if re.fullmatch(r"[A-Za-z0-9+/=_\-.]+", value):
        return "base64", 6.0
    return "print", 6.55


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def threshold(value: str, share: float) -> float:
    """``share`` of what a random string of this length and alphabet would show on average."""
    _, bits = alphabet(value)
    return share * min(bits, math.log2(max(2, len(value))))


def classes(value: str) -> int:
    return sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))


def is_stand_in(value: str) -> bool:
    return bool(PLACEHOLDER.search(value) or REFERENCE.search(value) or len(set(value)) <= 3 or value.startswith("<") and value.endswith(">"))


def is_other(value: str) -> bool:
    """Paths, identifiers, numbers, dates and the like."""
    return bool(UUID.match(value) or PATHLIKE.search(value) or IDENT.match(value) or re.fullmatch(r"[\d.,:\-+/% ]+(?:ms|s|m|h|kb|mb|gb|px)?", value, re.I) or value.startswith("data:"))


def plausible(value: str, strong: bool) -> bool:
    """A value under a credential's name."""
    n = len(value)
    if n < (5 if strong else 12) or is_stand_in(value) or is_other(value) or "://" in value:
        return False
    if " " in value:
        return False
    if n > 300 and alphabet(value)[0] == "print" and entropy(value) < threshold(value, 0.85):
        return False  # of this length only code and text show so little
    if value.endswith(("(", "{", "[")) or re.fullmatch(r"[\w.]+\(.*\)?;?", value):
        return False
    if not strong and HASH.match(value) and not HEX.match(value):
        return False
    if HASH.match(value) and re.match(r"(?i)sha|md5|h1|crc|\$2", value):
        return False
    kinds = classes(value)
    if kinds < 2:
        return False
    if value.isalpha():  # letters only: capitals must be scattered as no name has them
        return n >= 8 and len(re.findall(r"[a-z][A-Z]|[A-Z]{2}[a-z]", value)) >= 2 and entropy(value) >= threshold(value, 0.75)
    if strong and n < 12:
        return any(c.isdigit() for c in value) or kinds >= 3
    return entropy(value) >= threshold(value, 0.62 if strong else 0.7)


def is_dense(value: str) -> bool:
    """Of more than 64 characters without a blank only random ones vary so much; code and paths don't."""
    return len(value) <= 64 or entropy(value) >= threshold(value, 0.85)


def looks_issued(value: str) -> bool:
    """A password-like literal without a name: capitals, small letters, digits and a special sign."""
    return 8 <= len(value) and is_dense(value) and classes(value) >= 3 and any(c.isdigit() for c in value) and any(c in "!@#$%^&*~?+=" for c in value) and not is_stand_in(value) and "://" not in value and not is_other(value) and not HASH.match(value)


def looks_made_up(value: str) -> bool:
    """Letters with a run of digits, as people build passwords; versions, hosts, names and paths are not."""
    return 8 <= len(value) and is_dense(value) and any(c.isalpha() for c in value) and len(re.findall(r"\d", value)) >= 2 and not re.search(r"\.\w+\.|[/\\:]|\.\w{1,6}$|^v?\d", value) and not is_stand_in(value) and not is_other(value) and not HASH.match(value)


def decoded(value: str) -> str:
    """What a base64 value begins with."""
    head = value[: min(len(value), 96) // 4 * 4]
    try:
        return base64.b64decode(head).decode("latin-1")
    except ValueError:
        return ""


def is_blob(value: str, name: str, size: int) -> bool:
    """One encoded literal that makes up the text is data stored as code, unless its name is plain."""
    return len(value) >= DATA_FROM and len(value) > 0.6 * size and not STRONG.search(name) and not value.startswith("LS0t")


def looks_random(value: str, hint: bool) -> bool:
    """Random characters by their entropy, under any name or none. Small letters, capitals and digits must
    alternate as in no identifier; hexadecimal numbers are identifiers unless the name suits a credential."""
    n = len(value)
    if n < (16 if hint else 20) or is_stand_in(value) or is_other(value):
        return False
    if value.startswith("LS0t"):
        begun = decoded(value)
        if begun.startswith("-----BEGIN"):
            return "PRIVATE KEY" in begun
    if n >= DATA_FROM and not hint:
        return False
    share = 0.7 if hint else 0.8
    if HEX.match(value):
        return hint and n >= 24 and entropy(value) >= threshold(value, share)
    if HASH.match(value):
        return False
    kinds = value.translate(KINDS)
    if not ("a" in kinds and "A" in kinds and "0" in kinds) or sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) < (0.3 if hint else 0.35) * n:
        return False
    return entropy(value) >= threshold(value, share)


def unnamed(text: str) -> list[tuple[int, int]]:
    """Quoted strings and long tokens that are random, whatever their name, unless the name or what stands
    before them says that they are something else."""
    out: list[tuple[int, int]] = []
    blocks = [m.span() for m in PUBLIC_BLOCK.finditer(text)] if "-----BEGIN " in text else []
    for pattern, group in ((QUOTED, 2), (LONG, 0)):
        for m in pattern.finditer(text):
            value = m[group]
            if not looks_random(value, True):  # the lower bar first, before anything is looked up
                continue
            a, b = m.span(group)
            if any(x <= a < y for x, y in blocks):
                continue
            line = text.rfind("\n", 0, a) + 1
            before = text[max(line, a - 200) : a]
            if DIGEST_BEFORE.search(before) or ADDRESS_BEFORE.search(before):
                continue
            name = NAME_BEFORE.search(before)
            if name and NOT_SECRET.search(name[1]):
                continue
            if not before.strip() and b - a >= WRAPPED_AT and text[b : b + 1] in ("", "\r", "\n") and not value.startswith("LS0t"):
                continue  # a line of wrapped data
            if is_blob(value, name[1] if name else "", len(text)):
                continue
            if looks_random(value, bool(name and HINT.search(name[1]))):
                out.append((a, b))
    return out


def names(text: str, small: str) -> Iterator[tuple[int, int]]:
    """Bounds of each name that holds a stem, with what qualifies it (``a.b.db_password``). Of several parts of
    one dotted name the last with a stem counts, as that is what gets the value. Every name is walked once."""
    hits = sorted(m.span() for stem in STEMS for m in stem.finditer(small))
    k = 0
    run_end = 0
    while k < len(hits):
        begin, end = hits[k]
        a = begin
        while a > run_end and (text[a - 1].isalnum() or text[a - 1] in "_-.$"):
            a -= 1
        run_end = RUN.match(text, end).end()
        while k < len(hits) and hits[k][0] < run_end:
            end = max(end, hits[k][1])
            k += 1
        yield a, PART.match(text, end).end()


RUN = re.compile(r"[\w\-.$]*")
PART = re.compile(r"[\w\-]*")


def names_credential(name: str) -> bool:
    """The last word of the name tells: ``db_password`` does, ``password_hint`` and ``token.limit`` don't."""
    last = re.split(r"[.$]", name)[-1]
    if OTHER_LANGUAGES.search(last):
        return True
    words = [w.lower() for w in SPLIT.findall(last)]
    while words and (words[-1].isdigit() or len(words) > 1 and words[-1] in ENCODED):
        words.pop()
    if not words:
        return False
    if words[0] == "public" or "public" in words:
        return False
    if words[-1] in FINAL or JOINED.search("".join(words[-1:])):
        return True
    if words[-1] == "key" and len(words) > 1 and words[-2] in FINAL_KEYS:
        return True
    return bool(JOINED.search("".join(words)) and len(words) <= 3)


def literal(text: str, at: int, limit: int) -> tuple[int, int, str] | None:
    """A quoted string at ``at`` with what is joined to it: (start, end, joined value)."""
    m = LITERAL.match(text, at)
    if not m:
        return None
    start, end, value = m.start(2), m.end(2), m[2]
    pos = m.end()
    while c := CONCAT.match(text, pos):
        if "\n" not in c[0] and not c[0].strip():
            break
        if "\n" in c[0] and not c[0].strip() and not text[max(0, at - 60) : at].rstrip().endswith("("):
            break
        nxt = LITERAL.match(text, c.end())
        if not nxt or nxt.end() > limit:
            break
        value += nxt[2]
        end, pos = nxt.end(2), nxt.end()
    return start, end, value


BARE = re.compile(r"[^\s\"'`<>]+")
SEPARATOR = re.compile(r"[\"'`\])]*[ \t]*(?::[ \t]*(?:str|string|String|&str|char\*|const char\*)?[ \t]*=(?![=>])|:=|=>|=(?![=~])|:(?![:/]))[ \t]*")
ATTRIBUTE = re.compile(r"[\"'][ \t]+(?:value|val|default|content)[ \t]*=[ \t]*(?=[\"'])|[\"'][ \t]*,[ \t]*[\"']?(?:value|val|default)[\"']?[ \t]*[:=][ \t]*(?=[\"'])")
ELEMENT = re.compile(r"[\"']?>[ \t]*(?=[^<\s])")
CLAUSE = re.compile(r"[ \t]+(?:AS[ \t]+)?(?=')")
OPTION = re.compile(r"[ \t]+|=")
NEXT_LINE = re.compile(r"[ \t]*\(?[ \t]*\r?\n[ \t]*(?=[\"'])")
TF_DEFAULT = re.compile(r"[^{}]*?\bdefault[ \t]*=[ \t]*(?=[\"'])")
NAME_VALUE = re.compile(r"[\"']?[ \t]*,?[ \t]*\r?\n[ \t]*[\"']?(?:value|val|default)[\"']?[ \t]*[:=][ \t]*(?=\S)", re.I)


def value_at(text: str, pos: int, line_end: int, limit: int) -> tuple[int, int, str, bool] | None:
    """The value at ``pos``: (start, end, value, quoted)."""
    if d := DECODER.match(text, pos):
        pos = d.end()
    if text[pos : pos + 1] == "(":
        if n := NEXT_LINE.match(text, pos):
            pos = n.end()
        elif text[pos + 1 : pos + 2] in "\"'":
            pos += 1
    if text[pos : pos + 2] in ('f"', "f'"):
        return None
    if text[pos : pos + 2] in ('r"', "r'", 'b"', "b'", 'u"', "u'", '@"'):
        pos += 1
    if text[pos : pos + 1] in "\"'`":
        found = literal(text, pos, limit)
        return (*found, True) if found else None
    if m := BARE.match(text, pos, line_end):
        a, b = m.span()
        while b > a and text[b - 1] in ",;":
            b -= 1
        return a, b, text[a:b], False
    return None


def arguments(text: str, small: str) -> list[tuple[int, int]]:
    """Quoted strings between the parentheses of calls that sign in, over line feeds; a call that nothing
    closes has those on its line. One pass: each string and parenthesis is read once."""
    opens = sorted({c.end() - 1 for stem in CALLED for f in stem.finditer(small) if (c := CALL.match(text, f.end()))})
    strings: list[tuple[int, int]] = []
    depth: list[int] = []  # +1 where a call's strings begin, -1 after its last
    stack: list[tuple[int, int]] = []
    k, pos = 0, opens[0] if opens else len(text)

    def close(first: int, last: int) -> None:
        depth.extend([0] * (last + 1 - len(depth)))
        depth[first] += 1
        depth[last] -= 1

    while m := SCAN.search(text, pos):
        while k < len(opens) and opens[k] < m.start():
            k += 1
        pos = m.end()
        if m[0] == "(":
            called = k < len(opens) and opens[k] == m.start()
            stack.append((m.start() if called else -1, len(strings)))
        elif m[0] == ")":
            if stack:
                opened, first = stack.pop()
                if opened >= 0:
                    close(first, len(strings))
        elif k < len(opens) and opens[k] < m.end():
            pos = opens[k]  # a call within quotes, or quotes that are none: its own strings begin at its parenthesis
        elif m[1]:
            strings.append(m.span(2))
    begins = [a for a, _ in strings]
    for opened, first in stack:
        if opened >= 0:
            line_end = text.find("\n", opened)
            close(first, bisect_left(begins, len(text) if line_end < 0 else line_end, first))
    return [s for s, n in zip(strings, accumulate(depth), strict=False) if n > 0]


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sort) of each credential, in order, without overlap."""
    found: list[tuple[int, int, str]] = []
    size = len(text)
    ends = [m.end() for m in KEY_BLOCK_END.finditer(text)] if "-----END " in text else []
    for m in KEY_BLOCK.finditer(text):
        at = bisect_right(ends, m.end())
        if EMPTIED.match(text, m.end()):
            continue
        found.append((m.start(), ends[at] if at < len(ends) else m.end(), "key block"))
    for m in FORMATS.finditer(text):
        if not is_stand_in(m[0]) and entropy(m[0]) > 3.0:
            found.append((*m.span(), "format"))
    if "@" in text and "://" in text:
        for m in URL.finditer(text):
            if not is_stand_in(m[2]) and len(m[2]) >= 3:
                found.append((*m.span(2), "url"))
    small = text.translate(ASCII_LOWER) if len(text.lower()) != size else text.lower()
    if "authorization" in small or "private-token" in small or "api-key" in small or "x-" in small:
        for m in HEADER.finditer(text):
            g = 1 if m[1] else 2
            if len(m[g]) >= 8 and not is_stand_in(m[g]) and not IDENT.match(m[g]):
                found.append((*m.span(g), "header"))
    if "bearer" in small:
        for m in BEARER.finditer(text):
            if not is_stand_in(m[1]) and not is_other(m[1]) and entropy(m[1]) >= threshold(m[1], 0.7):
                found.append((*m.span(1), "header"))
    if "identified" in small:
        found += [(*m.span(1), "given") for m in IDENTIFIED.finditer(text) if plausible(m[1], True)]
    for word, pattern in GIVEN.items():
        if word in text:
            commands = [m.end() for m in COMMANDS[word].finditer(text)]
            for m in pattern.finditer(text):
                at = bisect_right(commands, m.start()) - 1  # the command stands before its option on one line
                if at >= 0 and text.find("\n", commands[at], m.start()) < 0 and plausible(m[1], True):
                    found.append((*m.span(1), "given"))
    lines: dict[int, tuple[list[int], list[int], list[int]]] = {}
    told: set[tuple[int, int, bool]] = set()
    judged: set[tuple[int, bool]] = set()  # a token near many names is judged once
    line_end = -1
    for a, b in names(text, small):
        if b > line_end:
            line_end = text.find("\n", b)
            line_end = size if line_end < 0 else line_end
        name = text[a:b].strip("-.")
        sort = STRONG.search(re.split(r"[.$]", name)[-1]) is not None
        named = names_credential(name)
        if named:
            hit = None
            if m := ATTRIBUTE.match(text, b, line_end) or SEPARATOR.match(text, b, line_end) or ELEMENT.match(text, b, line_end):
                hit = value_at(text, m.end(), line_end, size)
                if m.re is ELEMENT and hit:
                    stop = text.find("<", m.end(), line_end)
                    hit = (m.end(), stop, text[m.end() : stop].strip(), True) if stop > 0 else None
            elif (m := CLAUSE.match(text, b, line_end)) or text.startswith("--", a) and (m := OPTION.match(text, b, line_end)):
                hit = value_at(text, m.end(), line_end, size)
            elif (m := NEXT_LINE.match(text, b)) and m[0].lstrip().startswith("("):
                hit = value_at(text, m.end(), size, size)
            elif text[a - 1 : a] in ('"', "'") and text[b : b + 1] in ('"', "'") and re.search(r"variable[ \t]*$", text[max(0, a - 12) : a - 1]):
                brace = text.find("{", b + 1, b + 4)
                if brace > 0 and (m := TF_DEFAULT.match(text, brace + 1)):
                    hit = value_at(text, m.end(), size, size)
            elif re.search(r"name[\"']?[ \t]*[:=][ \t]*[\"']?$", text[max(0, a - 12) : a]) and (m := NAME_VALUE.match(text, b)):
                end = text.find("\n", m.end())
                hit = value_at(text, m.end(), size if end < 0 else end, size)
            if hit:
                x, y, value, quoted = hit
                if not quoted:
                    before = re.search(r"\S*\Z", text[max(0, a - 200) : a])[0]
                    if "://" in before and before[-1:] in "?&":
                        value = value.split("&", 1)[0]
                    elif ";" in value and re.search(r"[;=]$", text[max(0, a - 1) : a]):
                        value = value.split(";", 1)[0]
                    value = value.rstrip(")}]") if value.count("(") < value.count(")") or value.endswith(("}", "]")) else value
                    y = x + len(value)
                if plausible(value, sort) and not is_blob(value, name, size):
                    found.append((x, y, "named"))
                continue
        # prose and comments: "password is ...", "used ... as password", "sign in as ... with ..., same password"
        if PROSE.fullmatch(text, a, b) and text[b : b + 1] not in ("(", "[", "{", ".", "=", ";"):
            line_start, secret_word = text.rfind("\n", 0, a) + 1, text[a] in "pP"
            if line_start not in lines:
                spans = [t.span() for t in TOKENS.finditer(text, line_start, line_end)]
                lines[line_start] = [x for x, _ in spans], [y for _, y in spans], [m.end() for m in CLAUSE_END.finditer(text, line_start, line_end)]
            starts, stops, clauses = lines[line_start]
            at = bisect_right(clauses, a)
            clause = clauses[at - 1] if at else line_start, clauses[at] if at < len(clauses) else line_end
            for x, y in [(a - NEAR, b + NEAR), clause]:
                if (x, y, secret_word) in told:
                    continue
                told.add((x, y, secret_word))
                # every token that the stretch touches, in full
                for t0, t1 in zip(starts[(i := bisect_right(stops, x)) : (j := bisect_left(starts, y))], stops[i:j], strict=True):
                    if text[t1 : t1 + 1] in ("(", "[", "{", "<") or (t0, secret_word) in judged or t0 <= a < t1 and t1 - t0 > 64:
                        continue  # data that happens to hold the word says nothing
                    judged.add((t0, secret_word))
                    value = text[t0:t1]
                    value = value.rstrip(".,;:!?") if t1 < line_end and value.endswith((",", ";", ":")) else value
                    value = value.rstrip(",;:")
                    near = text[max(line_start, t0 - 64) : t0].rstrip().lower().endswith((" pass", " password", " pw", " pwd", " passphrase", "password is", "pass is", "pw is", "password:", "pass:", "pw:", "/pass", "/password"))
                    if looks_issued(value) or near and plausible(value, True) or secret_word and looks_made_up(value):
                        found.append((t0, t0 + len(value), "prose"))
    for a, b in arguments(text, small):
        value = text[a:b]
        if looks_issued(value) or looks_made_up(value) and (not value.isalnum() or classes(value) >= 3):
            found.append((a, b, "call"))
    found.sort(key=lambda x: (x[0], -x[1]))
    if loose := unnamed(text):
        taken = sorted((a, b) for a, b, _ in found)
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        # what another rule has found in part keeps that rule's bounds
        found += [(a, b, "random") for a, b in loose if not (i := bisect_left(starts, b)) or reach[i - 1] <= a]
        found.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str]] = []
    for a, b, sort in found:
        if kept and a < kept[-1][1]:
            if b > kept[-1][1]:
                kept[-1] = (kept[-1][0], b, kept[-1][2])
            continue
        kept.append((a, b, sort))
    return kept


def findings(text: str | None) -> list[tuple[int, int, str]]:
    return find(text) if text else []


def redact(text: str | None, mask: str = MASK) -> str | None:
    """The text with each credential's characters replaced; everything else is unchanged."""
    if not text:
        return text
    out, at = [], 0
    for a, b, sort in findings(text):
        if sort == "key block":
            a2, b2 = text.find("\n", a, b), text.rfind("\n", a, b)
            a, b = (a2 + 1, b2) if 0 <= a2 < b2 else (b, b)
            if a >= b:
                continue
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]]) if out else text


def locate(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, start_at, end_at, sort) of every credential."""
    schema = pa.schema([(key, pa.int64()), ("line_no", pa.int64()), ("start_at", pa.int64()), ("end_at", pa.int64()), ("sort", pa.string())])

    def run(rows: pa.RecordBatch):
        out = []
        for k, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            line, seen = 1, 0
            for a, b, sort in findings(t):
                line += t.count("\n", seen, a)
                seen = a
                out.append((k, line, a, b, sort))
        yield batch(schema, *([list(c) for c in zip(*out, strict=True)] or [[] for _ in schema.names]))

    return map_batches(spread(df.select(F.col(key).cast("long"), F.col(text)).where(F.length(text) > 0)), run, f"`{key}` long, line_no long, start_at long, end_at long, sort string")


def redacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, redacted) of every row, unchanged where nothing was found."""
    schema = pa.schema([(key, pa.int64()), ("redacted", pa.string())])

    def run(rows: pa.RecordBatch):
        yield batch(schema, rows.column(0), [redact(t) for t in rows.column(1).to_pylist()])

    return map_batches(spread(df.select(F.col(key).cast("long"), F.col(text))), run, f"`{key}` long, redacted string")


def p2_found(spark, sf_dir: str) -> DataFrame:
    """One row per line; a text's findings stay in one task, so lines are made distinct per text."""
    return locate(table(spark, sf_dir, "change_units"), "change_id", "after").select("change_id", "line_no").distinct()


def p2_redacted(spark, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "change_units"), "change_id", "after")


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
SQL: dict[str, str] = {}
