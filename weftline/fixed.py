"""Fixed values that results must agree on: word lists, the term dictionary, error codes, patterns."""

from __future__ import annotations

# Words that the language rule counts.
LANGUAGE_WORDS = {
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más pero sus le ya o este sí porque esta entre".split(),
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an they you were their one".split(),
}

# Words dropped besides common stop words.
EXTRA_STOP_WORDS = (
    "ser estar haber tener hacer poder deber ejemplo caso forma manera parte tipo vez año también así cual mismo otro cada sobre "
    "servicio aplicación sistema software dato usuario herramienta recurso proceso elemento conjunto nivel"
).split()

# Stop words of the frequency extractor.
FREQUENCY_STOP_WORDS = (
    "con del las los para por que una uno unos unas este esta estos estas como más pero sus sin sobre entre desde hasta donde cuando "
    "también muy son ser the and for from with this that into using"
).split()

# The dictionary of technical terms, with their canonical capitals.
TECHNOLOGIES = (
    "Java|Python|JavaScript|TypeScript|Kotlin|Swift|Go|Rust|C#|C++|PHP|Ruby|Scala|Perl|R|Dart|Elixir|"
    "Spring Boot|Spring|Django|Flask|FastAPI|Node.js|Express|Laravel|.NET|ASP.NET|Rails|NestJS|Quarkus|Micronaut|"
    "React|React Native|Angular|Vue.js|Next.js|Svelte|Nuxt|TailwindCSS|Bootstrap|HTML|CSS|Sass|Webpack|Vite|DOM|jQuery|"
    "PostgreSQL|MySQL|MongoDB|Redis|SQLite|Oracle|SQL|NoSQL|ChromaDB|Elasticsearch|Cassandra|DynamoDB|Neo4j|pgvector|SQLAlchemy|"
    "Docker|Kubernetes|Jenkins|GitLab|GitHub|Git|Terraform|Ansible|Nginx|Apache|Helm|Prometheus|Grafana|CI/CD|"
    "AWS|Azure|Google Cloud|OCI|Oracle Cloud|Object Storage|Lambda|Kafka|RabbitMQ|S3|EC2|Cloud Functions|"
    "TensorFlow|PyTorch|Scikit-Learn|Pandas|NumPy|spaCy|BERT|Transformers|Keras|XGBoost|Hugging Face|Jupyter|Matplotlib|NLTK|"
    "API REST|REST|GraphQL|gRPC|JSON|XML|YAML|OAuth|JWT|HTTPS|TLS|SSL|WebSocket|HTTP|SOAP|OpenAPI|Swagger|"
    "Android|iOS|Flutter|Xamarin|Ionic|"
    "Linux|Ubuntu|Debian|CentOS|Red Hat|Fedora|Alpine|Windows|Windows Server|macOS|Unix|WSL|Bash|Shell|PowerShell|systemd|cron|SSH|Firewall|"
    "VirtualBox|VMware|Podman|máquina virtual|"
    "machine learning|deep learning|microservicios|aprendizaje automático|redes neuronales|computación en la nube|arquitectura hexagonal|"
    "inyección de dependencias|programación orientada a objetos|test unitario"
).split("|")

# Error codes, in the order in which checks run.
MISSING, WRONG_TYPE, EMPTY, ENCODING, CORRUPT = "campo_faltante", "tipo_invalido", "campo_vacio", "codificacion_invalida", "texto_corrupto"
TOO_SHORT, TOO_LONG, DEGENERATE, UNSUPPORTED = "longitud_insuficiente", "longitud_excesiva", "contenido_degenerado", "idioma_no_soportado"

# Patterns of corruption and of what cleaning removes.
MOJIBAKE = "Ã[\x80-\xbf¡-ÿ]|â€[\x9c\x9d\x99\x93\x94]|Â[\xa0-\xbf]|ï»¿|Ã"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
REPLACEMENT = "�"
TAG = r"<[^>]+>"
URL = r"https?://[^\s\x{85}\x{a0}]+|www\.[^\s\x{85}\x{a0}]+"
REFERENCE = r"(?i)\[\d+\]|\[cita requerida\]|\[nota \d+\]"
TRIVIAL_PARENTHESIS = r"\([^)]{0,3}\)"
NOISE = r"[^\p{L}\p{N}_\s.,;:+#/-]"

# How pages are read.
NOISE_TAGS = "script style nav footer aside header form button svg noscript iframe".split()
INLINE_CODE = "code samp kbd var tt".split()
OUTLIER_LABEL = "(sin tema definido / outlier)"
VERDICTS = ("SIN CONTENIDO", "MUY POCO (¿SPA?)", "IDIOMA ", "OK")

#: Common function words of Spanish and English for token filtering; ours, since no linguistic model is at hand.
STOP_WORDS = sorted(
    set(LANGUAGE_WORDS["es"]) | set(LANGUAGE_WORDS["en"]) | set(FREQUENCY_STOP_WORDS)
    | set("ante bajo cabe contra hacia según tras durante mediante ni si cuyo cuya ello ella ellos ellas él yo tú nos les me te mi tu ha han he hay fue era eran "
          "está están esto eso esa ese aquel aquella quien quienes todo toda todos todas algo nada poco mucho muchos muchas más menos tan tanto".split())
)
