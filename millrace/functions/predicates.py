"""Predicates over paths, addresses, names and contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, endings and folders of files that hold secrets, of generated and of foreign ones, and private networks.
SECRET_NAMES = (
    ".env", ".envrc", ".netrc", "_netrc", ".npmrc", ".pypirc", ".htpasswd", ".pgpass", ".git-credentials", ".dockercfg", "credentials", "credentials.json", "secrets.json",
    "secrets.yaml", "secrets.yml", "kubeconfig", "terraform.tfvars", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519",
)
SECRET_EXTENSIONS = ("pem", "key", "p12", "pfx", "jks", "keystore", "asc", "gpg", "pgp", "ppk", "kdbx", "der", "crt", "cer")
SECRET_SUFFIXES = ("_rsa", "_dsa", "_ecdsa", "_ed25519")
SECRET_FOLDERS = (".ssh", ".gnupg", ".gpg", ".aws", ".azure", ".kube", ".docker")
FOREIGN_FOLDERS = (
    "node_modules", "bower_components", "vendor", "third_party", "thirdparty", "target", "dist", "build", "out", ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache", "__pycache__",
    ".venv", "venv", "site-packages", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".gradle", ".idea", ".vs", "Pods", "DerivedData", ".terraform", ".cargo", "coverage",
)
GENERATED_ENDINGS = (".min.js", ".min.css", ".min.mjs", ".map", ".bundle.js", ".pack.js")
PRIVATE = (
    ("0.0.0.0", 32), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _ends(name: Column, endings: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, endings)), lambda e: F.endswith(name, e))


def folders(path: Column) -> Column:
    """The folders on the way to a file."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def secret_file(name: Column) -> Column:
    """A file name that says that it holds secrets: a known one, any .env.*, a key's by its end, public halves of keys too, or by its extension if something is before it."""
    low = F.lower(name)
    said = lambda n: n.isin(*SECRET_NAMES) | _ends(n, SECRET_SUFFIXES)
    public = F.endswith(low, F.lit(".pub")) & said(F.regexp_replace(low, r"\.pub$", ""))
    return said(low) | F.startswith(low, F.lit(".env.")) | public | low.rlike(r"(?s)^.+\.(" + "|".join(SECRET_EXTENSIONS) + r")\z")


def secret_path(path: Column) -> Column:
    """A file whose name or a folder on whose way says that it holds secrets."""
    return secret_file(basename(path)) | F.exists(folders(path), lambda s: F.lower(s).isin(*SECRET_FOLDERS))


def foreign_path(path: Column) -> Column:
    """A file in a folder of dependencies, built files or caches; case counts."""
    return F.exists(folders(path), lambda s: s.isin(*FOREIGN_FOLDERS))


def generated(path: Column) -> Column:
    return _ends(F.lower(basename(path)), GENERATED_ENDINGS)


def minified(text: Column, longest: int) -> Column:
    """A line has more bytes than a person writes."""
    return F.coalesce(F.array_max(F.transform(F.split(text, "\n"), F.octet_length)) > longest, F.lit(False))


def content_gate(text: Column, longest: int) -> Column:
    """The reason for which a text is left out of an index, or null."""
    return F.when(F.contains(text, F.lit("\x00")), "binary").when(text.rlike(r"(?m)^\s*-----BEGIN[^\n]*PRIVATE KEY"), "secret").when(minified(text, longest), "minified")


def secret_name(name: Column) -> Column:
    """The name of a variable or argument that looks like a secret's."""
    return F.upper(name).rlike(r"(^|_|-)(KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIALS?|AUTH)($|_|-)")


def address(text: Column) -> Column:
    """A dotted address as a number; null for anything else."""
    parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)
    return F.when(text.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)\z"), number)


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _private(n: Column) -> Column:
    out = F.lit(False)
    for net, bits in PRIVATE:
        low = sum(int(p) << (24 - 8 * i) for i, p in enumerate(net.split(".")))
        out = out | n.between(low, low + (1 << (32 - bits)) - 1)
    return out


def groups(text: Column) -> Column:
    """The eight numbers of an address in groups, of which :: may stand for some that are 0 and the last two may be a dotted address; null for anything else."""
    none = F.array().cast("array<string>")
    cut = lambda h: F.when(h == "", none).otherwise(F.split(h, ":"))
    tail = F.regexp_extract(text, r"[0-9.]+\.[0-9.]+\z", 0)
    two = lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(65535)))
    plain = _bound(tail, lambda t: F.when(t == "", text).otherwise(F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(t)), _bound(address(t), two))))
    sides = _bound(plain, lambda p: F.transform(F.split(p, "::"), cut))

    def filled(s: Column) -> Column:
        left, right = F.get(s, F.lit(0)), F.coalesce(F.get(s, F.lit(1)), none)
        missing = 8 - F.size(left) - F.size(right)
        whole = F.when(F.size(s) == 2, missing >= 1).otherwise((F.size(s) == 1) & (missing == 0))
        return F.when(whole, F.concat(left, F.array_repeat(F.lit("0"), missing), right))

    numbers = lambda w: F.when(F.forall(w, lambda g: g.rlike(r"^[0-9A-Fa-f]{1,4}\z")), F.transform(w, lambda g: F.conv(g, 16, 10).cast("bigint")))
    return F.when(F.contains(text, F.lit(":")), _bound(_bound(sides, filled), numbers))


def private_address(text: Column) -> Column:
    """An address, dotted or in groups, that only a private network routes; a dotted one that groups carry is judged as itself; null for what is no address."""

    def of_groups(g: Column) -> Column:
        zeros = lambda k: F.forall(F.slice(g, 1, k), lambda x: x == 0)
        first, last = F.get(g, F.lit(0)), F.get(g, F.lit(7))
        carried = _bound(F.get(g, F.lit(6)) * 65536 + last, _private)
        own = (zeros(7) & last.isin(0, 1)) | (first >= 0xFF00) | (first.bitwiseAND(0xFE00) == 0xFC00) | (first.bitwiseAND(0xFFC0) == 0xFE80)
        return F.when(g.isNotNull(), F.when(zeros(5) & (F.get(g, F.lit(5)) == 0xFFFF), carried).otherwise(own))

    dotted = _bound(address(text), lambda n: F.when(n.isNotNull(), _private(n)))
    return F.coalesce(dotted, _bound(groups(text), of_groups))


def http_outcome(status: Column) -> Column:
    return F.when(status.between(200, 299), "success").when(status.isin(408, 425, 429) | (status >= 500), "retryable").otherwise("permanent")


def digest(text: Column) -> Column:
    """A SHA-256 in lower-case hex, without an algorithm's name before it; null for anything else."""
    d = F.regexp_replace(F.lower(F.trim(text)), "^sha256:", "")
    return F.when(d.rlike("^[0-9a-f]{64}$"), d)
