"""Files that nobody wrote by hand: generated, minified, vendored, lock files, source maps, data as code.

Paths are judged by Spark expressions. Text is judged in one Arrow pass per batch: a multi-pattern
automaton finds generation notices in the comment lines of a file's header, and a few shape measures
over the whole text (line lengths, share of blanks, share of lines that are literals) find minified
scripts and data stored as code. A notice counts where a clause of the comment states something about its
own file ("this file was generated", "code generated by", "do not edit"), not where its words are quoted or
said of other files. Text is only looked at where the path has not decided.

Defined cases: a null or empty path never matches by path; a null or empty text never matches by text;
documentation pages and aggregate sources (``@...``) are never matched; repeated rows are judged alike.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrow import batch, map_batches
from docloom.session import spread, table

# Folder names, file names and endings that tools and package managers use.
VENDORED = ["vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "externals", "node_modules", "bower_components", "site-packages", "godeps", "pods"]
BUILT = ["dist", "build", "target", "generated", "__generated__", "_generated", "generated-sources", ".next"]
LOCKS = ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "cargo.lock", "composer.lock", "gemfile.lock", "go.sum", "uv.lock", "packages.lock.json", "mix.lock", "podfile.lock", "gradle.lockfile", "flake.lock"]
ENDINGS = [r"\.min\.(js|css|mjs|cjs)", r"\.bundle\.(js|css)", r"\.chunk\.(js|css)", r"\.map", r"\.pb\.(go|cc|h)", r"_pb2(_grpc)?\.pyi?", r"\.g\.(cs|dart)", r"\.designer\.cs", r"\.generated\.\w+", r"[._-]gen\.(go|ts|js|py)", r"\.freezed\.dart", r"-lock\.json"]
STARTS = [r"zz_generated\."]

# The words that generation notices are built around, lower case. The automaton finds them; the
# patterns below decide whether the clause around one speaks of this file.
NOTICES = [
    "generated", "autogen", "auto-gen", "machine made", "machine-made", "do not", "don't", "never", "must not be", "should not be", "will be lost", "be overwritten", "regenerate", "re-generate", "produced automatically", "created automatically", "automatically produced",
    "automatically created", "vendored from", "copied from", "imported from", "mirrored from",
    "erzeugt", "generiert", "nicht", "généré", "ne pas", "ne modifiez", "generado", "no editar", "no modificar", "no edite", "no modifique", "gerado", "não", "generato", "non modificare", "gegenereerd", "niet",
    "сгенерирован", "создан автоматически", "не редакт", "не изменя", "自動生成", "編集しない", "变更", "自动生成", "自動產生", "请勿", "請勿", "자동 생성", "자동으로 생성", "수정하지",
]
FILE = r"(?:file|code|source|module|class|header|script|document|content|package|client|stub|binding|type|schema|definition|configuration|output|page)s?"
MADE = r"(?:(?:auto|machine)[- ]?)?(?:re)?(?:generated|created|produced|built|written|made|emitted)"
BY = r"(?:by|from|with|using|via|through|out of)"
# What a clause says that speaks of its own file. Each must begin the clause.
ABOUT_THIS = re.compile(
    # "this file was generated", "the code below is automatically produced by x"
    rf"(?:please note[:,]? |note[:,]? |warning[:,]? |caution[:,]? |attention[:,]? )?(?:this|the following|all|the code below|everything below)(?: \w+){{0,2}}? ?(?:{FILE} )?(?:is|are|was|were|has been|have been|gets?)(?: being)? (?:(?:an? )?(?:fully|automatically|auto|machine|code|tool)[- ]?)?(?:@?generated|autogenerated|{MADE}(?: (?:automatically|{BY}|on|at)))\b"
    # "code generated by x", "file automatically generated from y", "generated types"
    rf"|(?:{FILE} )?(?:(?:automatically|auto|machine|tool)[- ]?)?generated(?: {FILE})?(?: (?:automatically|{BY}|on|at|for|do not|don't|and must|and should|file|code|source)\b| ?[-:]| ?$)"
    rf"|(?:{FILE} )?(?:auto|machine)[- ]?(?:generated|created|made|gen)(?: {FILE})?(?: (?:automatically|{BY}|on|at|for|do not|don't)\b| ?[-:]| ?$)"
    rf"|(?:{FILE} )?(?:automatically (?:created|produced|written|built)|(?:created|produced|written|built) automatically)\b"
    r"|@generated\b|<auto-?generated|@auto-?generated"
    # what becomes of changes
    r"|(?:any |all |your |manual |local |hand )*(?:changes?|edits?|modifications?)(?: \w+){0,5} (?:will|would|may|might|can|get)(?: \w+)? ?(?:be )?(?:lost|overwritten|discarded|reverted)\b"
    r"|(?:please )?(?:re-?generate|re-?run|re-?build)\b[^,]*\b(?:instead|to update|to change|after|with|rather)\b"
    # further languages
    r"|(?:diese[rs]? \w+ (?:wurde|ist|wird) |die \w+ wurde )?(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|diese[rs]? \w+ (?:wurde|ist|wird)\b[^,]* (?:erzeugt|generiert)\b"
    r"|(?:ce|cette) \w+ (?:a été|est) (?:automatiquement )?(?:générée?|produite?)\b|(?:\w+ )?(?:générée?|produite?) (?:automatiquement|par)\b"
    r"|(?:este|esta) \w+ (?:fue|ha sido|es) (?:automáticamente )?generad[oa]\b|(?:\w+ )?generad[oa] (?:automáticamente|por)\b"
    r"|(?:este|esta) \w+ (?:foi|é) (?:automaticamente )?gerad[oa]\b|(?:\w+ )?gerad[oa] (?:automaticamente|por)\b|(?:questo|questa) \w+ (?:è|è stat[oa]) generat[oa]\b|(?:\w+ )?generat[oa] automaticamente\b|(?:dit|deze) \w+ is (?:automatisch )?gegenereerd\b|automatisch gegenereerd\b"
    r"|(?:этот |данный )?(?:файл|код) (?:был )?(?:автоматически )?(?:сгенерирован|создан автоматически)|(?:автоматически )?сгенерирован[оа]? (?:автоматически|с помощью)"
    r"|[^ ]{0,12}(?:自動生成|自动生成|自動產生)|[^.]{0,12}(?:자동 생성|자동으로 생성)"
    # copies of another project
    rf"|(?:(?:this|the) {FILE} (?:is|was) )?(?:vendored|copied|imported|mirrored)(?: (?:verbatim|unchanged|unmodified|as is))?,? from (?:https?://|git@|\S+\.\w+/|\S+@v?\d|\S+ v?\d)"
)
# What tells a reader to keep off this file; what follows must not speak of something else.
KEEP_OFF = re.compile(
    r"(?<!the )(?<!a )(?<!an )\b(?:do not|don't|never|must not be|should not be)(?: be)?(?: (?:hand|manually|ever|directly))?[- ]?(?:edit|modify|change|touch|alter|edited|modified|changed|touched|altered)\b"
    r"(?! (?:the|a|an|any|these|those|other|our|your|its|their)\b(?! (?:file|code|contents?|rest|lines? below)\b))(?! (?:without|unless|before|until|if|when|while|banners?|headers?|markers?|notices?|comments?|lines?|warnings?|messages?)\b)"
    r"|\b(?:nicht|nie) (?:(?:von hand|manuell|direkt) )?(?:ändern|bearbeiten|editieren|verändern)\b|\b(?:ne pas|ne jamais) (?:modifier|éditer)\b|\bne (?:modifiez|éditez) pas\b|\bno (?:editar|modificar|edite|modifique)\b|\bnão (?:editar|edite|modificar|modifique|altere|alterar)\b|\bnon modificare\b|\bniet (?:bewerken|wijzigen|aanpassen)\b"
    r"|не (?:редактируйте|редактировать|изменяйте|изменять)|編集しないで|请勿(?:编辑|修改|改动)|請勿(?:編輯|修改)|수정하지 마"
)
QUOTED = re.compile(r"(?<!\w)(['\"`“«])(?=\S)[^'\"`“”«»]*?\S['\"`”»](?!\w)")
CLAUSE = re.compile(r"[.!?。！？](?=\s|$)|;|: |\s[-–—|]+\s|。|！")
MARKERS = re.compile(r"^(?:///?|#+|--|/\*+|\*+/?|<!--|;+|%+)\s*|\s*(?:\*/|-->)$")
#: A notice stands in the file's leading comments, before the first code, or in its closing ones.
COMMENT = re.compile(r"^\s*(?://|#|--|/\*|\*|<!--|;|\"\"\"|'''|%|\{-|rem\b)", re.I)
TITLE = re.compile(r"^### FILE: .*(?:\r?\n|\r|$)")
STATEMENT = re.compile(r"[;{}]|\)\s*[;{]|=>")


def automaton(words: list[str]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for word in words:
        built.add_word(word, word)
    built.make_automaton()
    return built


_NOTICES = automaton(NOTICES)


def tidy(path: Column) -> Column:
    """One spelling per path: no blanks around, forward slashes, no ``./``, no doubled slashes, lower case."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    p = F.regexp_replace(p, r"/(\./)+", "/")
    return F.lower(F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), r"/{2,}", "/"))


def by_path(path: Column) -> Column:
    """True where the path alone tells; null and empty paths and aggregates are false."""
    p = tidy(path)
    folders = "|".join(re.escape(x) for x in VENDORED + BUILT)
    locks = "|".join(re.escape(x) for x in LOCKS)
    hit = (
        p.rlike(rf"(^|/)({folders})/")
        | p.rlike(rf"(^|/)({locks})$")
        | p.rlike("(" + "|".join(ENDINGS) + ")$")
        | p.rlike("(^|/)(" + "|".join(STARTS) + ")")
        # a hash between name and ending is what bundlers add for caches
        | p.rlike(r"(^|/)[\w.]+[-.](?=[0-9a-f]*[0-9])[0-9a-f]{8,20}\.(js|css|mjs)$")
    )
    return F.coalesce(hit & ~p.startswith("@") & (p != ""), F.lit(False))


def comments(text: str) -> list[str]:
    """The comment lines before the first and after the last line of code; a title line is skipped."""
    lines = TITLE.sub("", text, count=1).split("\n")
    found: list[str] = []
    inside = False
    for line in lines:
        bare = line.strip()
        if not bare:
            continue
        if not (inside or COMMENT.match(bare) or bare.startswith(("<?xml", "#!", "'use strict'", "package ", "syntax "))):
            break
        if bare.startswith(("/*", "<!--")):
            inside = True
        if "*/" in bare or "-->" in bare:
            inside = False
        found.append(bare)
    last: list[str] = []
    for line in reversed(lines):
        if line.strip():
            if not COMMENT.match(line):
                break
            last.append(line.strip())
    return found + last[::-1]


def says_so(comment: str) -> bool:
    """One clause of the comment states that this very file is made by a tool, copied, or not to be edited.
    What stands in quotes is spoken about; a clause with another subject speaks of other files."""
    bare = QUOTED.sub("#", comment)
    start = 0
    for end in [m.span() for m in CLAUSE.finditer(bare)] + [(len(bare), len(bare))]:
        clause = bare[start : end[0]].strip(" \t,*=#-_~[]()<>").removeprefix("and ") if not bare[start : start + 14].strip().startswith(("<auto", "@")) else bare[start : end[0]].strip()
        start = end[1]
        if any(True for _ in _NOTICES.iter(clause)) and (ABOUT_THIS.match(clause) or KEEP_OFF.search(clause)):
            return True
    return False


def has_notice(text: str) -> bool:
    """The header's and footer's comments are judged line by line, and each line with the next, as a notice may
    be wrapped. Only comments with one of the automaton's words are looked at."""
    before = ""
    for line in comments(text):
        low = re.sub(r"\s+", " ", MARKERS.sub("", line.lower())).strip()
        for piece in (low, f"{before} {low}" if before else ""):
            if piece and any(True for _ in _NOTICES.iter(piece)) and says_so(piece):
                return True
        before = low
    return False


DATA_LINE = re.compile(r"^[\s\[\](){},;:.+\-*/'\"_=0-9a-fA-FxX]*$")
INSERT = re.compile(r"^\s*insert into\b.*\bvalues\b", re.I)
LONG_LITERAL = re.compile(r"['\"`]([A-Za-z0-9+/=_\-\\]{200,})")


def is_minified(lines: list[str], size: int) -> bool:
    """Code packed on few lines: most of the text stands on long lines that hold many statements and few blanks."""
    packed = [line for line in lines if len(line) >= 500]
    if sum(map(len, packed)) < 0.6 * size:
        return False
    long = "".join(packed)
    blanks = long.count(" ") + long.count("\t")
    return blanks < 0.12 * len(long) and len(STATEMENT.findall(long)) > 0.02 * len(long)


def is_data(lines: list[str], size: int) -> bool:
    """Mostly literals: number lists, rows of inserts, or one encoded blob that makes up the file."""
    full = [line for line in lines if line.strip()]
    if not full:
        return False
    if sum(len(m) for line in full if len(line) > 200 for m in LONG_LITERAL.findall(line)) > 0.6 * size:
        return True
    if len(full) < 8:
        return False
    numbers = sum(1 for line in full if len(line.strip()) > 3 and DATA_LINE.match(line) and sum(map(str.isdigit, line)) * 4 >= len(line.strip()))
    return numbers >= 0.8 * len(full) or sum(1 for line in full if INSERT.match(line)) >= 0.8 * len(full)


def reason(text: str | None) -> str | None:
    """Why the text is not hand-written, or null."""
    if not text:
        return None
    if has_notice(text):
        return "notice"
    body = TITLE.sub("", text, count=1)
    lines = body.split("\n")
    if is_minified(lines, max(1, len(body))):
        return "minified"
    if is_data(lines, max(1, len(body))):
        return "data"
    return None


def by_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``reason`` of every row whose text tells."""
    schema = pa.schema([(key, pa.int64()), ("reason", pa.string())])

    def run(rows: pa.RecordBatch):
        judged = [(k, reason(t)) for k, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)]
        hit = [x for x in judged if x[1]]
        yield batch(schema, [k for k, _ in hit], [r for _, r in hit])

    return map_batches(spread(df.select(F.col(key).cast("long"), F.col(text).cast("string"))), run, f"`{key}` long, reason string")


def judged(spark, sf_dir: str) -> DataFrame:
    """All rows of both tables that are not hand-written, with the reason."""
    units = table(spark, sf_dir, "change_units").where("kind is null or kind <> 'docs'").select("change_id", "filePath", "after")
    facts = table(spark, sf_dir, "repo_facts").select("id", "source_path")
    path_units = units.where(by_path(F.col("filePath"))).select(F.lit("change_units").alias("src_table"), F.col("change_id").alias("row_id"), F.lit("path").alias("reason"))
    rest = units.where(~by_path(F.col("filePath")) & (F.length("after") > 0))
    text_units = by_text(rest, "change_id", "after").select(F.lit("change_units").alias("src_table"), F.col("change_id").alias("row_id"), "reason")
    path_facts = facts.where(by_path(F.col("source_path"))).select(F.lit("repo_facts").alias("src_table"), F.col("id").alias("row_id"), F.lit("path").alias("reason"))
    return path_units.unionByName(text_units).unionByName(path_facts)


def p4_found(spark, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("src_table", F.col("row_id").cast("long"))


def p4_reasons(spark, sf_dir: str) -> DataFrame:
    """Rows by table and reason."""
    return judged(spark, sf_dir).groupBy("src_table", "reason").agg(F.count("*").alias("n"))


QUERIES = {"p4_found": p4_found, "p4_reasons": p4_reasons}
SQL: dict[str, str] = {}
