"""Scripts: shadowed globals, rewritten imports, and code that stands for a global.

One compiled alternation walks a script once: strings and comments are passed
over, each other match is replaced where it stands, and nothing that was
replaced is looked at again. A script that names a global is then wrapped in a
block where that global is what the replay runtime offers; what the script
declares at its top level stays visible outside the block.
"""

from __future__ import annotations

import re

from palimpsest.functions.urls import rewrite_url

GLOBALS = tuple("window self document location top parent frames opener globalThis".split())
_NAMED = re.compile(r"(?<![\w$.])(?:" + "|".join(GLOBALS) + r")(?![\w$])")
_MODULE = re.compile(r"(?m)^\s*(?:import\s*(?:[\w*{][^;'\"]*from\s*)?['\"]|export\s+(?:default|const|let|var|function|class|\*|\{))")
_STRICT = re.compile(r"^\s*(?:/\*.*?\*/\s*|//[^\n]*\n\s*)*['\"]use strict['\"]", re.S)
_IMPORT = re.compile(r"""((?:^|[;\s}])(?:import|export)\s*(?:[\w*{$][^;'"()]*?from\s*)?)(['"])([^'"\n]+)(['"])""")
_THIS = "__replay_this(this)"
_EVAL = "__replay_eval((code, outer) => outer ? (0, eval)(code) : eval(code)).run(this, (function() { return arguments })(),"
_CHECK = "((self.__replay_location && self.__replay_location(location, arguments)) || {}).href = "
_OWN = "|".join(GLOBALS)


def _same(m: re.Match, options: dict) -> str:
    return m[0]


def _this(m: re.Match, options: dict) -> str:
    return m[0].replace("this", _THIS)


def _call_eval(m: re.Match, options: dict) -> str:
    before = m.string[: m.start()]
    if before and not before[-1].isspace():
        return m[0]
    return m[0] if re.search(r"(?:static|function|\})\s\Z", before[-10:]) else _EVAL


def _locate(m: re.Match, options: dict) -> str:
    strict = options["strict"] if options["strict"] is not None else "class " in m.string[: m.start()]
    return m[0] + (_CHECK.replace("arguments", "[]") if strict else _CHECK)


def _this_property(m: re.Match, options: dict) -> str:
    """A property of the global; on a line of its own with a semicolon, lest it be taken for an argument."""
    before = m.string[max(0, m.start() - 2) : m.start()]
    first = before[0] if len(before) == 2 and before[1].isspace() and before[0] not in ".$" else before[-1:]
    return (";" if first == "\n" else "") + _THIS


def _import(m: re.Match, options: dict) -> str:
    return "__replay_import(" + ("import.meta.url, " if options["module"] else "null, ")


#: (pattern, what to put); of patterns that match at one place the first counts.
_RULES: list[tuple[str, object]] = [
    (r"//[^\n]*|/\*(?s:.*?)\*/", _same),
    (r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", _same),
    (r"\beval\s*\(", _call_eval),
    (r"\(\w+,\s*eval\)\(", lambda m, o: " " + _EVAL),
    (r"=\s*eval\b(?![(:.$])", lambda m, o: m[0].replace("eval", "self.eval")),
    (r"\bvar\s+self\b", lambda m, o: m[0].replace("var", "let", 1)),
    (r"\.postMessage\(", lambda m, o: ".__replay_pm(self)" + m[0]),
    (r"\b(?:let|const)\s+location\s*=", _same),
    (r"(?<![$.+*/%^\w-])location\s*=\s*(?![\s\d=>])", _locate),
    (r"\breturn\s+this\b\s*(?![\s\w.$])", _this),
    (rf"(?<![$.\w])this(?=\.(?:{_OWN})\b)", _this_property),
    (r"[=,]\s*this\b\s*(?![\s\w:.$])", _this),
    (r"\}(?:\s*\))?\s*\(this\)", _this),
    (r"(?<=[^|&])(?:\|\||&&|\|&|&\|)\s*this\b\s*(?![|\s&.$](?:[^|&]|\Z))", _this),
    (r"\basync\s+import\s*\(", _same),
    (r"(?<![$.\w])import\s*\([^)]*\)\s*\{", _same),
    (r"(?<![$.\w])import\s*\(", _import),
]
_FUSED = re.compile("|".join(f"(?P<r{k}>{p})" for k, (p, _) in enumerate(_RULES)))


def _tokens(text: str):  # noqa: ANN202
    """(kind, text) of a script: string, template, comment, regex, word, other."""
    pattern = re.compile(
        r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")|(?P<template>`(?:[^`\\]|\\.)*`)"
        r"|(?P<word>[A-Za-z_$][\w$]*)|(?P<space>\s+)|(?P<other>.)",
        re.S,
    )
    for m in pattern.finditer(text):
        yield m.lastgroup, m[0]


def declared(text: str) -> set[str]:
    """Globals that the script declares itself at its top level."""
    depth, out, last, in_list = 0, set(), "", False
    for kind, t in _tokens(text):
        if kind in ("comment", "space", "string", "template"):
            continue
        if t in "{([":
            depth += 1
        elif t in "})]":
            depth -= 1
        elif kind == "word" and depth == 0:
            if last in ("let", "const", "class", "function") or (in_list and last == ","):
                out.add(t)
            in_list = in_list or t in ("let", "const")
        if t == ";":
            in_list = False
        last = t
    return out & set(GLOBALS)


def top_names(text: str) -> list[tuple[str, str, int]]:
    """(let or const, name, place of the keyword) of plain declarations at the top level."""
    depth, at, kind, where, want = 0, 0, "", 0, False
    out: list[tuple[str, str, int]] = []
    last = ""
    for group, t in _tokens(text):
        place, at = at, at + len(t)
        if group in ("comment", "space"):
            if kind and not want and "\n" in t and last not in (",", "=", "(", "+", "."):
                kind = ""  # the line ends the statement
            continue
        if t in "{([" and group == "other":
            if want:
                kind, want = "", False  # a pattern: its names stay inside
            depth += 1
        elif t in "})]" and group == "other":
            depth -= 1
        elif depth == 0:
            if group == "word" and want:
                out.append((kind, t, where))
                want = False
            elif group == "word" and t in ("let", "const") and last != ".":
                kind, where, want = t, place, True
            elif t == "," and kind:
                want = True
            elif t == ";":
                kind, want = "", False
        last = t
    return out


def is_module(text: str) -> bool:
    return bool(_MODULE.search(text))


def is_strict(text: str) -> bool:
    return bool(_STRICT.match(text))


def rewrite_imports(text: str, prefix: str, base: str) -> str:
    """Static imports and exports from absolute or relative addresses."""

    def fix(m: re.Match) -> str:
        target = m[3]
        if not re.match(r"https?://|\.{0,2}/", target):
            return m[0]
        return m[1] + m[2] + rewrite_url(target if target.startswith("http") else _absolute(base, target), prefix, base, force=True) + m[4]

    return _IMPORT.sub(fix, text)


def _absolute(base: str, url: str) -> str:
    from palimpsest.functions.urls import whatwg_join

    return whatwg_join(base, url)


def replaced(text: str, module: bool = False, strict: bool | None = None) -> str:
    """Code that stands for a global replaced, in one pass."""
    options = {"module": module, "strict": True if module else strict}
    return _FUSED.sub(lambda m: _RULES[int(m.lastgroup[1:])][1](m, options), text)


def _visible(text: str) -> tuple[str, str, str, str]:
    """What is declared before the block, the script, and what ends and follows the block, so that
    top-level names outlive it."""
    before = inside = after = ""
    cuts = set()
    for kind, name, place in top_names(text):
        if name in GLOBALS:
            continue
        if kind == "let":
            before += f"let {name};\n"
            cuts.add(place)
        else:
            inside += f"self.__replay_const_{name} = {name};\n"
            after += f"const {name} = self.__replay_const_{name}; delete self.__replay_const_{name};\n"
    for place in sorted(cuts, reverse=True):
        text = text[:place] + text[place + 3 :]
    return before, text, "\n;" + inside if inside else "", "\n" + after if after else ""


def rewrite_js(text: str, prefix: str = "", base: str = "", inline: bool = False, module: bool | None = None, worker: bool = False) -> str:
    """A script for replay (H20); one that names no global is not wrapped."""
    module = is_module(text) if module is None else module
    out = replaced(text, module, True if is_strict(text) else None)
    if module and prefix:
        out = rewrite_imports(out, prefix.replace("mp_/", "esm_/"), base)
    if worker:
        return f'self.importScripts("{prefix}replay-worker.js");\n' + out if prefix else out
    named = bool(_NAMED.search(text))
    shadow = [g for g in GLOBALS if g not in declared(text)]
    if module:
        return f'import {{ {", ".join(shadow)} }} from "{prefix}__replay_module.js";\n' + out if named else out
    if not named:
        return out.replace("\n", " ") if inline else out
    lets = " ".join(f'let {g} = __replay_get("{g}");' for g in shadow)
    head = "var __replay_get = function(n) { return (self.__replay && self.__replay.get && self.__replay.get(n)) || self[n]; };"
    before, out, inside, after = _visible(out)
    if inline:
        return (before + head + " { " + lets + " " + out + inside + " }" + after).replace("\n", " ")
    strict = "'use strict';" if is_strict(text) else ""
    return f"{strict}{before}{head}\n{{\n{lets}\nlet arguments;\n\n{out}{inside}\n\n}}{after}"
