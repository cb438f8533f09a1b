"""Connection addresses: parse, infer the dialect, build, and read from the environment."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

# Schemes and their dialects, and the ports they default to.
DIALECTS = {"postgres": "postgres", "postgresql": "postgres", "snowflake": "snowflake", "bigquery": "bigquery", "file": "parquet", "parquet": "parquet"}
PORTS = {"postgres": 5432}
_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


@dataclass(frozen=True)
class Address:
    dialect: str
    host: str = ""
    port: int | None = None
    database: str = ""
    schema: str = ""
    user: str = ""
    password: str = field(default="", repr=False)
    options: tuple[tuple[str, str], ...] = ()

    def jdbc(self) -> str:
        """The JDBC address, without credentials."""
        if self.dialect == "postgres":
            return f"jdbc:postgresql://{self.host}:{self.port or PORTS['postgres']}/{self.database}"
        if self.dialect == "snowflake":
            extra = urlencode([("db", self.database), ("schema", self.schema), *self.options])
            return f"jdbc:snowflake://{self.host}.snowflakecomputing.com/?{extra}"
        if self.dialect == "bigquery":
            extra = "".join(f";{k}={v}" for k, v in (("DefaultDataset", self.schema), *self.options) if v)
            return f"jdbc:bigquery://https://www.googleapis.com/bigquery/v2:443;ProjectId={self.database}{extra}"
        raise ValueError(f"{self.dialect} has no JDBC address")

    def text(self, password: bool = False) -> str:
        """The address again; the password only on request."""
        if self.dialect == "parquet":
            return f"file://{self.database}"
        secret = (":" + quote(self.password, safe="")) if password and self.password else ""
        user = f"{quote(self.user, safe='')}{secret}@" if self.user else ""
        port = f":{self.port}" if self.port else ""
        path = "/".join(p for p in (self.database, self.schema) if p)
        tail = "?" + urlencode(self.options) if self.options else ""
        return f"{self.dialect}://{user}{self.host}{port}/{path}{tail}"


def infer_dialect(text: str) -> str:
    scheme = text.split("://", 1)[0].split("+", 1)[0].lower() if "://" in text else "file"
    if scheme not in DIALECTS:
        raise ValueError(f"unknown scheme {scheme!r}; known: {', '.join(sorted(DIALECTS))}")
    return DIALECTS[scheme]


def parse(text: str) -> Address:
    """postgresql://user:pw@host:port/db, snowflake://user:pw@account/db/schema?warehouse=w,
    bigquery://project/dataset, file:///folder or a plain folder."""
    text = interpolate(text.strip())
    if not text:
        raise ValueError("an address is empty")
    dialect = infer_dialect(text)
    if dialect == "parquet":
        return Address(dialect, database=text.split("://", 1)[-1])
    u = urlsplit(text)
    parts = [unquote(p) for p in u.path.split("/") if p]
    if not u.hostname:
        raise ValueError(f"no host, account or project in {dialect} address")
    if dialect != "bigquery" and not parts:
        raise ValueError(f"no database in {dialect} address")
    database, schema = (parts + ["", ""])[:2]
    if dialect == "bigquery":
        return Address(dialect, database=u.netloc.rpartition("@")[2], schema=database, options=tuple(parse_qsl(u.query)))
    return Address(dialect, u.hostname, u.port or PORTS.get(dialect), database, schema, unquote(u.username or ""), unquote(u.password or ""), tuple(parse_qsl(u.query)))


def interpolate(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default} from the environment; a name that is not set is an error."""
    env = os.environ if env is None else env

    def value(m: re.Match) -> str:
        got = env.get(m[1], m[2])
        if got is None:
            raise KeyError(f"environment variable {m[1]} is not set")
        return got

    return _VARIABLE.sub(value, text)


def parse_array_literal(text: str | None) -> list[str | None]:
    """A PostgreSQL array literal: {a,"b,c",NULL}. Null and empty give an empty list."""
    if text is None or not text.strip():
        return []
    body = text.strip()
    if not (body.startswith("{") and body.endswith("}")):
        raise ValueError(f"not an array literal: {text!r}")
    token = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|([^,"]*?))\s*(?:,|$)')
    out: list[str | None] = []
    body, at = body[1:-1], 0
    while at < len(body):
        m = token.match(body, at)
        if not m:
            raise ValueError(f"not an array literal: {text!r}")
        out.append(re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else None if m[2].upper() == "NULL" else m[2])
        at = m.end()
    return out


def parse_qualified(text: str, database: str) -> tuple[str, str] | None:
    """(schema, table) of a three-part name, quoted or not; None for another database."""
    m = re.fullmatch(r'"((?:[^"]|"")+)"\."((?:[^"]|"")+)"\."((?:[^"]|"")+)"', text.strip())
    parts = [p.replace('""', '"') for p in m.groups()] if m else text.strip().split(".")
    if len(parts) != 3 or parts[0].lower() != database.lower():
        return None
    return parts[1], parts[2]


def sealed(spark, text: str, key: str) -> str:
    """An address encrypted for storing (AES-GCM; the key is any text, hashed to 256 bits)."""
    got = spark.sql("SELECT base64(aes_encrypt(:t, unhex(sha2(:k, 256)), 'GCM')) AS s", args={"t": text, "k": key})
    return got.first()["s"]


def opened(spark, text: str, key: str) -> str:
    """The address again; with another key an error."""
    got = spark.sql("SELECT decode(aes_decrypt(unbase64(:t), unhex(sha2(:k, 256)), 'GCM'), 'UTF-8') AS s", args={"t": text, "k": key})
    return got.first()["s"]
