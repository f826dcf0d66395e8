"""The policy: a small record that becomes constants of the plan."""

from __future__ import annotations

import json
import logging
import os
import re
from dataclasses import dataclass, field
from typing import Any

from ..functions import tables as t

log = logging.getLogger("unisift")


@dataclass
class Policy:
    encoding: str = "utf-8-only"
    identifier_policy: str = "ascii-only"
    permitted_scripts: set[str] = field(default_factory=lambda: {"Latin", "Common", "Inherited"})
    #: Rule name to severity.
    severity: dict[str, str] = field(default_factory=dict)
    #: Risk (high, medium, low) to globs.
    file_policies: dict[str, list[str]] = field(default_factory=dict)
    #: (globs, code points) that are allowed.
    allow: list[tuple[list[str], set[int]]] = field(default_factory=list)
    #: Context to rule name to action.
    contexts: dict[str, dict[str, str]] = field(default_factory=dict)
    diff_only: bool = True

    def severity_of(self, rule_id: str) -> str:
        rule = t.RULES.get(rule_id)
        return self.severity.get(rule.name, rule.severity) if rule else "critical"

    def ignores(self, rule_name: str) -> list[str]:
        """Contexts in which the rule is ignored."""
        return [c for c, actions in self.contexts.items() if actions.get(rule_name) == "ignore"]


def glob_regex(glob: str) -> str:
    """An anchored regular expression: `*` and `**` match anything, `?` one character, `[...]` and `[!...]` sets."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            first = i + (glob[i : i + 1] == "!")
            end = glob.find("]", first + 1)
            if end < 0:
                out.append(r"\[")
                continue
            body = re.sub(r"([\\^\[\]&~])", r"\\\1", glob[first:end])
            out.append(f"[{'^' if first > i else ''}{body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + r"\z"


def character_spec(spec: Any) -> set[int]:
    """A code point by number, `U+HEX` or name; nothing and a warning if it isn't one."""
    cp = None
    if isinstance(spec, int) and not isinstance(spec, bool):
        cp = spec
    elif isinstance(spec, str):
        if spec in t.NAMED_CHARACTERS:
            cp = t.NAMED_CHARACTERS[spec]
        elif re.fullmatch(r"[Uu]\+[0-9A-Fa-f]+", spec):
            cp = int(spec[2:], 16)
    if cp is None or not 0 <= cp <= 0x10FFFF:
        log.warning("unknown character in policy: %r", spec)
        return set()
    return {cp}


def policy_from(given: dict[str, Any] | None) -> Policy:
    """A policy from the parsed file; absent keys keep their defaults, unknown ones are ignored."""
    given = given or {}
    out = Policy()
    for key in ("encoding", "identifier_policy", "diff_only"):
        if given.get(key) is not None:
            setattr(out, key, given[key])
    if given.get("permitted_scripts") is not None:
        out.permitted_scripts = set(given["permitted_scripts"])
    out.severity = {name: level.lower() for name, level in (given.get("severity") or {}).items() if isinstance(level, str) and level.lower() in t.SEVERITIES}
    for key, globs in (given.get("file_policies") or {}).items():
        if (risk := re.fullmatch(r"(high|medium|low)(?:[-_]risk)?", key)):
            out.file_policies.setdefault(risk[1], []).extend(globs.get("patterns", []) if isinstance(globs, dict) else globs)
    for entry in given.get("allow") or []:
        points = set().union(*map(character_spec, entry.get("characters") or []), set())
        out.allow.append((list(entry.get("paths") or ["**"]), points))
    out.contexts = {context: dict(actions or {}) for context, actions in (given.get("contexts") or {}).items()}
    return out


def load_policy(path: str | None) -> Policy:
    """The policy of a .yml, .yaml or .json file; the default one if there is no such file or it's blank."""
    if not path or not os.path.isfile(path):
        return Policy()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not text.strip():
        return Policy()
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".json":
        return policy_from(json.loads(text))
    if suffix in (".yml", ".yaml"):
        try:
            import yaml
        except ImportError as e:  # the library is optional
            raise RuntimeError("YAML policies need the yaml package; use JSON") from e
        return policy_from(yaml.safe_load(text))
    raise ValueError(f"Unsupported policy format: {suffix}")
