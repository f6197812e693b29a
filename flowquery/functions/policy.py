"""Security levels, concerns, compliance and trust by policy."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Rule:
    """A level, or levels by a parameter: of the thresholds that compare true the nearest counts, else ``default``."""

    default: int
    operator: str = "=="
    thresholds: tuple[tuple[int, int], ...] = ()

    def level(self, parameter: Column | None) -> Column:
        if parameter is None or not self.thresholds:
            return F.lit(self.default)
        nearest = sorted(self.thresholds, reverse=self.operator.startswith(">"))
        met = [F.when(COMPARE[self.operator](parameter, at), level) for at, level in nearest]
        return F.coalesce(*met, F.lit(self.default))


@dataclass(frozen=True)
class Policy:
    """``levels``: a rule for each value of each attribute; ``unknown``: the level of a value without one."""

    levels: dict[str, dict[str, Rule]]
    names: dict[int, str] = field(default_factory=dict)
    unknown: int = 0

    @classmethod
    def from_json(cls, text: str) -> Policy:
        """From an object with ``classification`` (name to level) and ``rules``: attribute to value to a level, or to a ``default`` with one parameter's ``operator`` and ``thresholds``."""
        found = json.loads(text)

        def rule(x) -> Rule:
            if not isinstance(x, dict):
                return Rule(int(x))
            inner = next((v for v in x.values() if isinstance(v, dict)), {})
            steps = tuple((int(k), int(v)) for k, v in inner.get("thresholds", {}).items())
            return Rule(int(x["default"]), inner.get("operator", "=="), steps)

        rules = {a: {v: rule(x) for v, x in values.items()} for a, values in found["rules"].items()}
        return cls(rules, {n: name for name, n in found["classification"].items()})

    def level(self, attribute: str, value: Column, parameter: Column | None = None) -> Column:
        known = [F.when(value == v, rule.level(parameter)) for v, rule in self.levels[attribute].items()]
        return F.when(value.isNotNull(), F.coalesce(*known, F.lit(self.unknown)))

    def floor(self, values: dict[str, tuple[Column, Column | None]]) -> Column:
        """The lowest level of the attributes that a row has."""
        return F.array_min(F.array(*(self.level(a, v, p) for a, (v, p) in values.items())))

    def concerns(self, values: dict[str, tuple[Column, Column | None]], threshold: int, parameters: dict[str, str] | None = None) -> Column:
        """A line for each attribute at or below the threshold."""
        lines = []
        for a, (v, p) in values.items():
            text = F.concat(F.lit(f"{a} - "), v)
            if p is not None and a in (parameters or {}):
                text = F.concat(text, F.lit(f" {parameters[a]} "), p.cast("string"))
            lines.append(F.when(self.level(a, v, p) <= threshold, text))
        return F.array_compact(F.array(*lines))

    def classification(self, level: Column) -> Column:
        return F.coalesce(*(F.when(level == n, name) for n, name in self.names.items()), F.lit("unknown"))


def compliant(value: Column, allowed: Sequence[str]) -> Column:
    return F.when(value.isNull(), "unknown").when(value.isin(*allowed), "yes").otherwise("no")


def trust(issuers: Column, trusted: Sequence[str]) -> Column:
    """The last certificate's issuer: trusted, named, or missing."""
    last = F.try_element_at(issuers, F.lit(-1))
    return F.when(F.size(issuers) < 1, "no certs data").when(last.isNull(), "CA is none").when(last.isin(*trusted), "trusted").otherwise(F.concat(F.lit("CA not trusted: "), last))


def tls_security(policy: Policy, suite: Column, client_key_length: Column, certs: Column, threshold: int = 2, unknowns: str = "report", trusted: Sequence[str] = ()) -> Column:
    """struct(classification, concerns) of a TLS flow.

    ``suite``: struct(kex, sig, enc, auth, hash) or null; ``certs``: array of struct(signature_algo, signature_key_size, issuer).
    ``client_key_length`` is as recorded, with 16 bits of encoding. ``unknowns``: "ignore" leaves values without a rule out of the lowest level.
    """
    length = client_key_length - 16
    attributes = [a for a in ("kex", "sig", "enc", "auth", "hash") if a in policy.levels]
    values = {a: (suite[a], length if a == "kex" else None) for a in attributes}
    levels = F.array(*(policy.level(a, v, p) for a, (v, p) in values.items()))
    if unknowns == "ignore":
        levels = F.filter(levels, lambda x: x != policy.unknown)
    of_suite = F.when(suite.isNotNull(), F.array_min(levels))
    lines = F.when(suite.isNotNull(), policy.concerns(values, threshold, {"kex": "client_key_length"})).otherwise(F.array().cast("array<string>"))

    level = lambda x: policy.level("cert_sig_alg", x["signature_algo"], x["signature_key_size"])
    of_certs = F.array_min(F.transform(certs, level)) if "cert_sig_alg" in policy.levels else F.lit(None).cast("int")

    def concern(x: Column, i: Column) -> Column:
        return F.when(level(x) <= threshold, F.concat(F.lit("cert_sig_alg - "), x["signature_algo"], F.lit(" sig_key_size "), x["signature_key_size"].cast("string"), F.lit(" in cert "), i.cast("string")))

    weak = F.array_compact(F.transform(certs, concern)) if "cert_sig_alg" in policy.levels else F.array().cast("array<string>")
    audit = trust(F.transform(certs, lambda x: x["issuer"]), trusted)
    untrusted = F.when(audit != "trusted", F.array(audit)).otherwise(F.array().cast("array<string>"))
    concerns = F.concat(F.when(certs.isNull(), F.array(F.lit("no certs data"))).otherwise(F.concat(weak, untrusted)), lines)
    return F.struct(policy.classification(F.least(of_suite, of_certs)).alias("classification"), concerns.alias("concerns"))
