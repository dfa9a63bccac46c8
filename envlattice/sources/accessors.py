"""How 16 languages read environment variables: a table of patterns, and what follows a read."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from envlattice.sources.masks import SYNTAX, Masked
from envlattice.sources.positions import Positions

TAIL, LITERAL, MAX_BYTES = 64, 4096, 8 << 20
_ID = r"[A-Za-z_][A-Za-z0-9_]*"
_QUOTED = rf"(?P<q>['\"])(?P<name>{_ID})(?P=q)"
_LITERAL = re.compile(r"""[ \t]*(?P<q>["'])(?P<text>(?:\\[\s\S]|(?!(?P=q))[^\\\n])*)(?P=q)""")

# Names that bundlers set, and that the command interpreter has.
VITE_BUILT_INS = "MODE DEV PROD SSR BASE_URL ASSETS_PREFIX KEYS".split()
CMD_BUILT_INS = (
    "CD ERRORLEVEL CMDEXTVERSION CMDCMDLINE DATE TIME RANDOM USERNAME USERDOMAIN COMPUTERNAME PATH PATHEXT PROMPT OS "
    "PROCESSOR_ARCHITECTURE NUMBER_OF_PROCESSORS HOMEDRIVE HOMEPATH TEMP TMP WINDIR COMSPEC APPDATA LOCALAPPDATA "
    "PROGRAMFILES SYSTEMROOT PUBLIC ALLUSERSPROFILE LOGONSERVER SESSIONNAME"
).split()


@dataclass(frozen=True)
class Follow:
    """What stands behind a read: a fallback, with its literal where there is one, or that the read asserts."""

    fallback: bool = False
    literal: str | None = None
    required: bool | None = None


def literal_at(code: str, at: int) -> str | None:
    """A quoted literal on the same line, of bounded length."""
    m = _LITERAL.match(code, at, min(len(code), at + LITERAL))
    return m["text"] if m else None


def _behind(pattern: str) -> Callable[[str, int], Follow | None]:
    found = re.compile(pattern)

    def follow(code: str, end: int) -> Follow | None:
        m = found.match(code, end, end + TAIL)
        return Follow(True, literal_at(code, m.end())) if m else None

    return follow


argument = _behind(r"\s*,\s*")
coalesce = _behind(r"\s*\]?\s*(?:\?\?|\|\|)\s*")
defined_or = _behind(r"\s*//\s*")
_block = _behind(r"[ \t]*\)[ \t]*\{[ \t]*")
_CHAIN = re.compile(rf"\s*\)\s*\.\s*({_ID})")
_WRITE = re.compile(r"\s*\]?\s*(?:\+|-|\*|/|//|\*\*|<<)?=(?!=)")


def fetch(code: str, end: int) -> Follow | None:
    return argument(code, end) or _block(code, end)


def chain(code: str, end: int) -> Follow | None:
    """Methods on a result: unwrapping asserts, other forms of it are fallbacks."""
    m = _CHAIN.match(code, end, end + TAIL)
    if m is None:
        return None
    if m[1] in ("unwrap", "expect"):
        return Follow(required=True)
    if m[1] not in ("unwrap_or", "unwrap_or_else", "unwrap_or_default", "ok"):
        return None
    given = m[1] == "unwrap_or" and code[m.end() : m.end() + 1] == "("
    return Follow(True, literal_at(code, m.end() + 1) if given else None)


def operator(code: str, end: int) -> Follow | None:
    """Behind ``${NAME`` and an operator: a question mark asserts, a minus sign gives a default."""
    if code[end - 1] == "?":
        return Follow(required=True)
    close = code.find("}", end, end + LITERAL)
    return Follow(True, code[end:close] or None) if close >= 0 else None


def is_write(code: str, end: int) -> bool:
    stop = code.find("\n", end)
    return _WRITE.match(code, end, min(stop if stop >= 0 else len(code), end + TAIL)) is not None


@dataclass(frozen=True)
class Accessor:
    """One way to read: a pattern with a name, and a quote ``q`` where the place of a read is that of its quote."""

    id: str
    label: str
    languages: tuple[str, ...]
    pattern: re.Pattern
    required: bool = False
    fallback: bool = False
    follow: Callable[[str, int], Follow | None] | None = None
    skip_write: bool = False
    code_only: bool = True
    gate: re.Pattern | None = None
    skip: Callable[[str, str, int], bool] | None = None
    via_import: bool = False


def _path(dotted: str) -> str:
    return r"\s*\.\s*".join(map(re.escape, dotted.split(".")))


def _index(before: str, path: str) -> re.Pattern:
    return re.compile(rf"{before}{path}\s*\[\s*{_QUOTED}(?=\s*\])", re.A)


def _call(before: str, path: str, end: str = "[,)]", quoted: str = _QUOTED) -> re.Pattern:
    return re.compile(rf"{before}{path}\s*\(\s*{quoted}(?=\s*{end})", re.A)


_DOT, _WORD, _RUST = r"(?<![\w.])", r"(?<![\w$])", r"(?<![\w:.])"
_JS = r"(?<![.\w$])(?:(?:globalThis|global|window|self)\s*\.\s*)?"
_CHAINED = r"(?:[A-Za-z_][A-Za-z0-9_]*\s*\.\s*)*"
_BACKTICK = _QUOTED.replace("['\\\"]", "['\\\"`]")
_SCRIPTS, _JVM = ("javascript", "typescript"), ("java", "kotlin")


def _known(name: str, code: str, end: int) -> bool:
    return name.upper() in CMD_BUILT_INS


_SET = re.compile(r"(?:^|\n)[ \t]*set[ \t]+\"?([A-Za-z_][A-Za-z0-9_]*)=[^\n]*\Z", re.I)


def _batch_write(name: str, code: str, end: int) -> bool:
    m = _SET.search(code[max(0, end - TAIL) : end])
    return _known(name, code, end) or bool(m and m[1].upper() == name.upper())


def _js_member(id_: str, label: str, path: str, skip=None) -> list[Accessor]:
    dot = re.compile(rf"{_JS}{path}\s*\.\s*(?P<name>{_ID})", re.A)
    bracket = re.compile(rf"{_JS}{path}\s*(?:\??\.\s*)?\[\s*{_QUOTED}(?=\s*\])", re.A)
    return [Accessor(id_, label, _SCRIPTS, p, follow=coalesce, skip=skip) for p in (dot, bracket)]


def _rust(path: str) -> re.Pattern:
    return re.compile(rf"{_RUST}{path}\s*\(\s*(?P<q>\")(?P<name>{_ID})\"", re.A)


_PROCESS = r"process\s*\??\.\s*env"
ACCESSORS = [
    Accessor("js-process-env", "process.env", _SCRIPTS, re.compile(rf"{_JS}{_PROCESS}\s*\??\.\s*(?P<name>{_ID})", re.A), follow=coalesce),
    _js_member("js-process-env", "process.env", _PROCESS)[1],
    *_js_member("js-import-meta-env", "import.meta.env", _path("import.meta.env"), lambda n, c, e: n in VITE_BUILT_INS),
    *_js_member("js-bun-env", "Bun.env", _path("Bun.env")),
    Accessor("js-deno-env-get", "Deno.env.get", _SCRIPTS, _call(_JS, _path("Deno.env.get")), follow=argument),
    Accessor("py-os-environ-index", "os.environ", ("python",), _index(_DOT, _path("os.environ")), required=True, skip_write=True),
    Accessor("py-os-environ-get", "os.environ", ("python",), _call(_DOT, _path("os.environ.get")), follow=argument),
    Accessor("py-os-environ-setdefault", "os.environ", ("python",), _call(_DOT, _path("os.environ.setdefault")), follow=argument),
    Accessor("py-os-getenv", "os.getenv", ("python",), _call(_DOT, _path("os.getenv")), follow=argument),
    Accessor("go-os-getenv", "os.Getenv", ("go",), _call(_DOT, _path("os.Getenv"), r"\)", _BACKTICK)),
    Accessor(
        "go-bare-getenv", "os.Getenv", ("go",), _call(_DOT, "Getenv", r"\)", _BACKTICK),
        gate=re.compile(r"^[ \t]*(?:import\s+)?(?:[A-Za-z_][A-Za-z0-9_]*\s+)?\"os\"[ \t]*(?://.*)?$", re.M),
    ),
    Accessor("go-os-lookupenv", "os.LookupEnv", ("go",), _call(_DOT, _path("os.LookupEnv"), r"\)", _BACKTICK), fallback=True),
    Accessor("rust-env-var", "env::var", ("rust",), _rust(r"(?:(?:(?:std\s*::\s*)?env|dotenvy|dotenv)\s*::\s*var)"), follow=chain),
    Accessor(
        "rust-bare-var", "env::var", ("rust",), _rust("var"), follow=chain,
        gate=re.compile(r"^[ \t]*use\s+(?:std\s*::\s*env\s*::\s*(?:var|\{[^}]*\bvar\b[^}]*\})|env\s*::\s*var)\s*;", re.M),
    ),
    Accessor("jvm-system-getenv", "System.getenv", _JVM, _call(_DOT, _path("System.getenv") + r"(?:\s*\(\s*\)\s*\.\s*get)?")),
    Accessor("jvm-system-getproperty", "System.getProperty", _JVM, _call(_DOT, _path("System.getProperty")), follow=argument),
    Accessor(
        "cs-get-environment-variable", "Environment.GetEnvironmentVariable", ("csharp",),
        _call(_DOT, _path("Environment.GetEnvironmentVariable")),
    ),
    Accessor("cs-iconfiguration", "IConfiguration", ("csharp",), _index(_DOT, _CHAINED + r"(?:[Cc]onfiguration|IConfiguration)")),
    Accessor(
        "cs-get-connection-string", "GetConnectionString", ("csharp",), _call(_DOT, _CHAINED + "GetConnectionString", r"\)"), required=True
    ),
    Accessor("rb-env-index", "ENV", ("ruby",), _index(_DOT, "ENV"), required=True, follow=coalesce, skip_write=True),
    Accessor("rb-env-fetch", "ENV.fetch", ("ruby",), _call(_DOT, _path("ENV.fetch")), required=True, follow=fetch),
    Accessor("php-getenv", "getenv", ("php",), _call(_WORD, "getenv")),
    Accessor("php-env-superglobal", "$_ENV", ("php",), _index(_WORD, r"\$_ENV"), skip_write=True),
    Accessor("php-server-superglobal", "$_SERVER", ("php",), _index(_WORD, r"\$_SERVER"), skip_write=True),
    Accessor("php-laravel-env", "env", ("php",), _call(_WORD, r"(?:env|Env\s*::\s*get)"), follow=argument),
    Accessor(
        "perl-env", "%ENV", ("perl",), re.compile(rf"{_WORD}\$ENV\s*\{{\s*(?P<quote>['\"]?)(?P<name>{_ID})(?P=quote)\s*\}}", re.A),
        follow=defined_or,
    ),
    Accessor(
        "sh-parameter", "shell-parameter", ("shell",),
        re.compile(r"\$\{(?P<name>[A-Za-z_][A-Za-z0-9_]+):?[-?](?=[^}])"), follow=operator,
    ),
    Accessor("sh-parameter", "shell-parameter", ("shell",), re.compile(r"\$\{(?P<name>[A-Za-z_][A-Za-z0-9_]+)\}")),
    Accessor("sh-parameter", "shell-parameter", ("shell",), re.compile(r"(?<![$\\])\$(?!\{)(?P<name>[A-Za-z_][A-Za-z0-9_]+)")),
    Accessor(
        "sh-printenv", "printenv", ("shell",),
        re.compile(rf"(?<![\w.$/\\-])printenv(?:[ \t]+-{{1,2}}[A-Za-z][A-Za-z-]*)*[ \t]+(?P<name>{_ID})(?![\w-])", re.A), required=True,
    ),
    Accessor(
        "batch-parameter", "batch-parameter", ("batch",), re.compile(r"%(?P<name>[A-Z][A-Z0-9_]+)%"), code_only=False, skip=_batch_write
    ),
    Accessor(
        "batch-defined", "batch-parameter", ("batch",),
        re.compile(r"(?:^|[ \t])if[ \t]+(?:not[ \t]+)?defined[ \t]+(?P<name>[A-Z][A-Z0-9_]+)(?![\w])", re.M | re.A),
        code_only=False, skip=_known,
    ),
    Accessor(
        "swift-process-environment", "ProcessInfo.processInfo.environment", ("swift",), _index(_DOT, _path("ProcessInfo.processInfo.environment"))
    ),
    Accessor(
        "swift-environment-foundation", "ProcessInfo.processInfo.environment", ("swift",), _index(_DOT, "environment"),
        gate=re.compile(r"^[ \t]*import\s+(?:Foundation|SwiftUI|AppKit|UIKit)\b", re.M),
    ),
    Accessor("dart-platform-environment", "Platform.environment", ("dart",), _index(_DOT, _path("Platform.environment"))),
    Accessor("dart-string-from-environment", "String.fromEnvironment", ("dart",), _call(_DOT, _path("String.fromEnvironment")), follow=argument),
    Accessor("ex-system-get-env", "System.get_env", ("elixir",), _call(_DOT, _path("System.get_env"), r"\)")),
    Accessor("ex-system-fetch-env", "System.fetch_env", ("elixir",), _call(_DOT, _path("System.fetch_env"), r"\)")),
    Accessor("ex-system-fetch-env-bang", "System.fetch_env", ("elixir",), _call(_DOT, _path("System.fetch_env") + "!", r"\)"), required=True),
]

_PARTS = re.compile(r"""["'`](?:\\[\s\S]|[^\\"'`])*["'`]|[\[({]|[\])}]|,|=|[^"'`\[({\])},=]+|[\s\S]""")
_DESTRUCTURING = re.compile(rf"\{{(?P<body>[^{{}}]{{0,500}})\}}\s*(?::[^=;]*)?=\s*{_JS}process\s*\.\s*env\b", re.A)
_IMPORT = re.compile(r"import\s*\{(?P<body>[^}]{0,500})\}\s*from\s*['\"](?P<module>\$env/(?P<kind>static|dynamic)/(?:private|public))['\"]")
_BINDING = re.compile(rf"\[\s*(?P<b>(?P<q1>['\"])(?P<n1>{_ID})(?P=q1))\s*\]|(?P<q>(?P<q2>['\"])(?P<n2>{_ID})(?P=q2))|(?P<n3>{_ID})(?=\s*(?::|\Z))")
_PY_IMPORT = re.compile(rf"(?<![\w.])from\s+os\s+import\s+environ(?![A-Za-z0-9_])(?:\s+as\s+({_ID}))?", re.A)
_PY_CLASS = re.compile(rf"^(?P<indent>[ \t]*)class\s+{_ID}\s*\(\s*(?P<base>{_ID})", re.M)
_PY_FIELD = re.compile(rf"(?P<indent>[ \t]*)(?P<name>{_ID})\s*:\s*(?P<rest>.*)")


def _split(body: str) -> list[tuple[int, str, int]]:
    """(offset, text, offset of its assignment sign or -1) of the parts between commas, nesting and quotes honoured."""
    out, depth, start, sign = [], 0, 0, -1
    for m in _PARTS.finditer(body + ","):
        t = m[0]
        if t in "[({":
            depth += 1
        elif t in "])}":
            depth -= 1
        elif t == "," and (depth <= 0 or m.start() == len(body)):
            out.append((start, body[start : m.start()], sign - start if sign >= 0 else -1))
            start, sign = m.end(), -1
        elif t == "=" and depth <= 0 and sign < 0 and (body + "  ")[m.end()] not in "=>" and body[m.start() - 1 : m.start()] not in tuple("=><!+-*/%&|^~:"):
            sign = m.start()
    return out


class _Reads:
    """Collects reads of one text."""

    def __init__(self, text: str, language: str, path: str):
        self.masked = Masked(text, language)
        self.code, self.place, self.language, self.path = self.masked.code, Positions(text), language, path
        self.out: set[tuple] = set()

    def add(self, name: str, offset: int, label: str, follow: Follow | None = None, required=False, fallback=False, via=False) -> None:
        follow = follow or Follow(fallback)
        line, column = self.place.at(offset)
        needed = required if follow.required is None else follow.required
        self.out.add((
            name, self.path, line, column, self.language, label, follow.fallback, bool(needed), via, follow.literal,
        ))

    def accessor(self, a: Accessor) -> None:
        if a.gate and not a.gate.search(self.code):
            return
        for m in a.pattern.finditer(self.code):
            name, end = m["name"], m.end()
            if a.code_only and self.masked.in_string(m.start()) or a.skip_write and is_write(self.code, end) or a.skip and a.skip(name, self.code, end):
                continue
            at = next((m.start(g) for g in ("q", "quote") if g in m.re.groupindex and m[g]), m.start("name"))
            self.add(name, at, a.label, a.follow(self.code, end) if a.follow else None, a.required, a.fallback, a.via_import)

    def destructuring(self) -> None:
        for m in _DESTRUCTURING.finditer(self.code):
            if self.masked.in_string(m.start()):
                continue
            for offset, text, sign in _split(m["body"]):
                key = text if sign < 0 else text[:sign]
                lead = len(key) - len(key.lstrip())
                b = _BINDING.match(key.strip())
                if b is None or text.strip().startswith("..."):
                    continue
                at = m.start("body") + offset + lead
                place = at + (b.start("b") if b["b"] else 0)
                literal = literal_at(self.code, m.start("body") + offset + sign + 1) if sign >= 0 else None
                self.add(b["n1"] or b["n2"] or b["n3"], place, "process.env", Follow(sign >= 0, literal))

    def imports(self) -> None:
        for m in _IMPORT.finditer(self.code):
            for offset, text, _ in _split(m["body"]):
                lead = len(text) - len(text.lstrip())
                b = re.match(_ID, text.strip())
                if b is None or re.match(r"type\s", text.strip()):
                    continue
                if m["kind"] == "static":
                    self.add(b[0], m.start("body") + offset + lead, m["module"], required=True, via=True)
                else:
                    start = rf"(?<![\w.$]){re.escape(b[0])}"
                    for p in (rf"{start}\s*\.\s*(?P<name>{_ID})", rf"{start}\s*\[\s*{_QUOTED}(?=\s*\])"):
                        self.accessor(Accessor("js-env-dynamic-import", m["module"], _SCRIPTS, re.compile(p, re.A), via_import=True))

    def environ_imports(self) -> None:
        for binding in sorted({m[1] or "environ" for m in _PY_IMPORT.finditer(self.code)}):
            path = re.escape(binding)
            self.accessor(Accessor("py-environ-import", "os.environ", ("python",), _index(_DOT, path), required=True, skip_write=True))
            call = _call(_DOT, path + r"\s*\.\s*(?:get|setdefault)")
            self.accessor(Accessor("py-environ-import", "os.environ", ("python",), call, follow=argument))

    def settings(self) -> None:
        """Annotated fields of classes whose base is named like settings."""
        for m in _PY_CLASS.finditer(self.code):
            if not m["base"].endswith("Settings"):
                continue
            at = self.code.find("\n", m.end()) + 1
            while 0 < at <= len(self.code):
                stop = self.code.find("\n", at)
                line = self.code[at : stop if stop >= 0 else len(self.code)].removesuffix("\r")
                body = line.lstrip()
                if body:
                    if len(line) - len(body) <= len(m["indent"]) or body.startswith("class "):
                        break
                    f = _PY_FIELD.fullmatch(line)
                    if f and not re.match(r"model_|Config$|_", f["name"]):
                        sign = next((s + o for o, _, s in _split(f["rest"]) if s >= 0), -1)
                        literal = literal_at(f["rest"], sign + 1) if sign >= 0 else None
                        self.add(f["name"], at + f.start("name"), "BaseSettings", Follow(sign >= 0, literal), required=sign < 0)
                at = stop + 1


def scan(path: str, text: str, language: str) -> list[tuple]:
    """Rows of the usages relation of one file, each once, in order of place, name and accessor."""
    if language not in SYNTAX:
        return []
    reads = _Reads(text, language, path)
    for a in ACCESSORS:
        if language in a.languages:
            reads.accessor(a)
    if language in _SCRIPTS:
        reads.destructuring()
        reads.imports()
    elif language == "python":
        reads.environ_imports()
        reads.settings()
    found = reads.out
    del reads  # places and masks are as large as the rows
    return sorted(found, key=lambda r: (r[2], r[3], r[0], r[5], r[6], r[7], r[9] or ""))


def ids() -> Iterator[str]:
    """All accessors' ids, those of more than one pattern once."""
    extra = ["js-process-env-destructuring", "js-env-static-import", "js-env-dynamic-import", "py-environ-import", "py-pydantic-settings"]
    return iter(dict.fromkeys([*(a.id for a in ACCESSORS), *extra]))
