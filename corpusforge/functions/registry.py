"""Package registries: which one a name belongs to, its URL and its answer.

Fetching needs a network and is left to the caller; everything else is an expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Registry:
    name: str
    prefixes: tuple[str, ...]
    url: str  # %s is the encoded package
    version: str  # path of the version in the answer


#: Registries in the order in which they are tried.
REGISTRIES = {
    "npm": Registry("npm", ("npm:",), "https://registry.npmjs.org/%s/latest", "$.version"),
    "pypi": Registry("PyPI", ("pip:", "pypi:"), "https://pypi.org/pypi/%s/json", "$.info.version"),
    "crates": Registry("crates.io", ("cargo:", "crates:", "rust:"), "https://crates.io/api/v1/crates/%s", "$.crate.max_version"),
    "go": Registry("Go", ("go:",), "https://proxy.golang.org/%s/@latest", "$.Version"),
    "rubygems": Registry("RubyGems", ("gem:", "ruby:"), "https://rubygems.org/api/v1/gems/%s.json", "$.version"),
    "nuget": Registry("NuGet", ("nuget:", "dotnet:"), "https://api.nuget.org/v3-flatcontainer/%s/index.json", "$.versions"),
    "packagist": Registry("Packagist", ("composer:", "php:"), "https://repo.packagist.org/p2/%s.json", "$.packages"),
    "hex": Registry("Hex", ("hex:", "elixir:", "mix:"), "https://hex.pm/api/packages/%s", "$.releases[0].version"),
    "pub": Registry("pub.dev", ("pub:", "dart:", "flutter:"), "https://pub.dev/api/packages/%s", "$.latest.version"),
    "maven": Registry("Maven Central", ("maven:", "java:"), "https://search.maven.org/solrsearch/select?q=g:%s+AND+a:%s&rows=1&wt=json", "$.response.docs[0].latestVersion"),
    "homebrew": Registry("Homebrew", ("brew:", "homebrew:"), "https://formulae.brew.sh/api/formula/%s.json", "$.versions.stable"),
    "conda": Registry("Conda", ("conda:",), "https://api.anaconda.org/package/conda-forge/%s", "$.latest_version"),
}
_NPM_NAME = "(?i)^[a-z0-9][-a-z0-9._]*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def detect_registry(package: Column | str) -> Column:
    """Struct of the registry's key and the package's clean name.

    An explicit prefix decides first (npm's is not one of them), then the shape of the
    name: npm, then Go, Packagist and Maven; npm if nothing fits.
    """
    p = _col(package)
    bare = F.regexp_replace(p, "^npm:(?=.)", "")
    key = F.when(p.startswith("@") | F.regexp_replace(p, "^npm:", "").rlike(_NPM_NAME), "npm")
    key = key.when(F.contains(p, F.lit("/")) & F.contains(p, F.lit(".")), "go").when(F.contains(p, F.lit("/")), "packagist").when(F.contains(p, F.lit(":")), "maven").otherwise("npm")
    clean = F.when(key == "npm", bare).otherwise(p)
    for name, r in reversed(REGISTRIES.items()):
        if name != "npm":
            pattern = f"^(?:{'|'.join(r.prefixes)})(.+)$"
            hit = p.rlike(pattern)
            key, clean = F.when(hit, name).otherwise(key), F.when(hit, F.regexp_extract(p, pattern, 1)).otherwise(clean)
    return F.struct(key.alias("registry"), clean.alias("package"))


def encode_component(text: Column) -> Column:
    """Percent-encoding as in a URI component: a space is %20; !'()* stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(code), F.lit(c))
    return out


def registry_url(registry: Column | str, package: Column | str) -> Column:
    """URL of the package's latest version; null for a Maven name without an artifact."""
    r, p = _col(registry), _col(package)
    parts = F.when(F.contains(p, F.lit(":")), F.split(p, ":")).otherwise(F.split(p, "/"))
    group, artifact = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    out = F.lit(None).cast("string")
    for name, reg in REGISTRIES.items():
        if name == "maven":
            head, middle, tail = reg.url.split("%s")
            url = F.when(artifact != "", F.concat(F.lit(head), encode_component(group), F.lit(middle), encode_component(artifact), F.lit(tail)))
        else:
            head, tail = reg.url.split("%s")
            url = F.concat(F.lit(head), encode_component(F.lower(p) if name == "nuget" else p), F.lit(tail))
        out = F.when(r == name, url).otherwise(out)
    return out


def registry_version(registry: Column | str, answer: Column | str) -> Column:
    """Version in the registry's JSON answer; null where there is none.

    NuGet: the last listed version.  Packagist: the first package's first version whose
    text has no "dev", else its first.
    """
    r, body = _col(registry), _col(answer)
    out = F.lit(None).cast("string")
    for name, reg in REGISTRIES.items():
        if name == "nuget":
            value = F.element_at(F.from_json(F.get_json_object(body, reg.version), "array<string>"), -1)
        elif name == "packagist":
            packages = F.from_json(F.get_json_object(body, reg.version), "map<string,array<struct<version:string>>>")
            listed = F.transform(F.try_element_at(F.map_values(packages), F.lit(1)), lambda v: v["version"])
            value = F.coalesce(F.try_element_at(F.filter(listed, lambda v: ~F.contains(v, F.lit("dev"))), F.lit(1)), F.try_element_at(listed, F.lit(1)))
        else:
            value = F.get_json_object(body, reg.version)
        out = F.when(r == name, value).otherwise(out)
    return out
