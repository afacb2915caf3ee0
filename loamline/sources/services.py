"""Services that a project talks to, by its settings' keys, its containers and the addresses in its source."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.sources.files import rows_of

# A service, whole segments of keys that stand for it, and beginnings of segments; words in container files;
# parts of keys of internal addresses; parts that a key's label goes without.
KEYS = (
    ("PostgreSQL", ("PG",), ("POSTGRES",)),
    ("MySQL", (), ("MYSQL", "MARIADB")),
    ("Redis", (), ("REDIS",)),
    ("MongoDB", (), ("MONGO",)),
    ("Elasticsearch", (), ("ELASTIC", "OPENSEARCH")),
    ("Ollama", (), ("OLLAMA",)),
    ("OpenAI", (), ("OPENAI",)),
    ("Anthropic", (), ("ANTHROPIC",)),
    ("AWS S3", ("S3", "AWS"), ()),
    ("Azure", (), ("AZURE",)),
    ("GCP", ("GCP",), ()),
    ("Cloudinary", (), ("CLOUDINARY",)),
    ("RabbitMQ", ("AMQP",), ("RABBITMQ",)),
    ("Kafka", (), ("KAFKA",)),
    ("Email Service", (), ("SMTP", "SENDGRID", "MAILGUN")),
    ("SMS Service", ("SMS",), ("TWILIO",)),
    ("Firebase", (), ("FIREBASE",)),
    ("Stripe", (), ("STRIPE",)),
    ("Sentry", (), ("SENTRY",)),
)
WHOLE_KEYS = {"DATABASE_URL": "PostgreSQL"}
CLOUD_KEY = ("GOOGLE_CLOUD", "GCP")
INTERNAL_KEYS = ("_API_URL", "_CORE_URL", "_SERVICE_URL", "_REMOTE_URL", "_INTERNAL")
CONTAINERS = (("PostgreSQL", ("postgres",)), ("MySQL", ("mysql", "mariadb")), ("Redis", ("redis",)), ("MongoDB", ("mongo",)), ("RabbitMQ", ("rabbitmq",)), ("Kafka", ("kafka",)), ("Elasticsearch", ("elasticsearch", "opensearch")), ("MinIO/S3", ("minio",)), ("Nginx", ("nginx",)))
LABEL_PARTS = ("_URL", "_URI", "_BASE", "_HOST", "_ENDPOINT", "_API")
ENV_FILES, COMPOSE_FILES = (".env", ".env.example", ".env.local"), ("docker-compose.yml", "docker-compose.yaml", "compose.yml")
CODE = ("ts", "js", "py", "go", "rs", "dart", "java", "kt", "rb", "php", "verse")
NO_URL = ("${", "{{", "example.com", "placeholder")
LOCAL = ("localhost", "127.0.0.1", "0.0.0.0")


def of_keys(keys: list[str]) -> Iterator[str]:
    segments = {s for k in keys for s in re.split("[^A-Z0-9]+", k.upper()) if s}
    for service, whole, begins in KEYS:
        if segments & set(whole) or any(s.startswith(begins) for s in segments if begins):
            yield service
    for k in (k.upper() for k in keys):
        if k in WHOLE_KEYS:
            yield WHOLE_KEYS[k]
        if k.startswith(CLOUD_KEY[0]):
            yield CLOUD_KEY[1]
        if any(p in k for p in INTERNAL_KEYS):
            yield "Internal APIs"


def of_local_address(key: str, value: str, ports: dict[int, str]) -> str | None:
    """A setting that points at a port of this machine: the service there, else a label from the key."""
    m = re.match(r"http://(?:localhost|127\.0\.0\.1|0\.0\.0\.0)[^/:]*:(\d+)", value.strip().strip("\"'").lower())
    if not m or int(m[1]) > 65535:
        return None
    key, port = key.strip().upper(), int(m[1])
    if port in ports:
        return f"→ {ports[port]} ({key})"
    label = key
    for p in LABEL_PARTS:
        label = label.replace(p, "")
    label = label.replace("_", " ").strip()
    return f"Internal: {label} :{port}" if len(label) > 2 else f"Internal :{port}"


def of_url(url: str, ports: dict[int, str]) -> str | None:
    low = url.lower()
    m = re.match(r"https?://([^/:]*)(?::(\d+))?([^/]*)(/.*)?$", low, re.S)
    if not m or any(x in low for x in NO_URL):
        return None
    host, port, path = m[1], m[2], m[4] or ""
    if host in LOCAL:
        if not port or int(port) > 65535:
            return None
        if int(port) in ports:
            parts = [x for x in path.split("/") if x][:2]
            return f"→ {ports[int(port)]}" + (f" (/{'/'.join(parts)}/…)" if parts else "")
        return f"Internal :{int(port)}"
    if "." in host and not host.endswith((".local", ".internal")):
        return "API: " + ".".join(host.split(".")[-2:])
    return None


def service_rows(path: str, text: str, ports: dict[int, str] | None = None) -> Iterator[tuple]:
    """(service, path) of each service that a file speaks of."""
    name, ext, found = path.rsplit("/", 1)[-1], path.rsplit(".", 1)[-1], []
    if name in ENV_FILES:
        pairs = [ln.strip().split("=", 1) for ln in text.split("\n") if "=" in ln and not ln.strip().startswith("#")]
        found += of_keys([k.strip() for k, _ in pairs])
        found += [x for k, v in pairs if (x := of_local_address(k, v, ports or {}))]
    elif name in COMPOSE_FILES:
        low = text.lower()
        found += [service for service, words in CONTAINERS if any(w in low for w in words)]
    elif ext in CODE:
        for quote in "\"'`":
            for url in re.findall(rf"{quote}(https?://[^{quote} \n\r]*)", text):
                if len(url) > 10 and (x := of_url(url, ports or {})):
                    found.append(x)
    for service in dict.fromkeys(found):
        yield service, path


def external_services(files: DataFrame, ports: dict[int, str] | None = None) -> DataFrame:
    """(service, path) with the first file, by path, that speaks of each service; ports: services of this project by port."""
    known = dict(ports or {})
    got = rows_of(files, lambda p, t: service_rows(p, t, known), "service string, path string")
    return got.groupBy("service").agg(F.min("path").alias("path"))
