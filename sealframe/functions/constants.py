"""Fixed values of the packet format."""

# Limits, format names and the default key dictionary of the packet format.
MAX_DEPTH = 100
MAX_KEYS_PER_OBJECT = 10_000
MAX_ARRAY_LENGTH = 500_000
MAX_STRING_BYTES = 16 * 1024 * 1024
MAX_PACKET_BYTES = 32 * 1024 * 1024
MAX_DECOMPRESSED_BYTES = 32 * 1024 * 1024
MAX_COMPRESSED_BUFFER_BYTES = 48 * 1024 * 1024
MAX_BASE64_PAYLOAD_CHARS = 70 * 1024 * 1024
MAX_REF_EXPANSION_DEPTH = 500

VERSION = "1"
SPEC_VERSION = "1"
SUPPORTED_MAJOR_VERSION = 1
ENCODING = "canonical-json"
HASH_ALGORITHM = "sha256"
PAYLOAD_ENCODING = "base64"
PRIVACY_SPEC_VERSION = "1"
PRIVACY_POLICY_VERSION = "v1"
REF_KEY = "__ip_ref"
NUM_ADD_KEY = "__ip_num_add"
DEFAULT_DICTIONARY = {
    "timestamp": "ts",
    "user_id": "uid",
    "amount": "amt",
    "currency": "cur",
    "temperature": "tmp",
    "schema_ref": "sch",
    "event_type": "et",
    "device_id": "did",
    "session_id": "sid",
    "request_id": "rid",
    "correlation_id": "cid",
    "metadata": "meta",
    "created_at": "c_at",
    "updated_at": "u_at",
    "description": "desc",
    "latitude": "lat",
    "longitude": "lon",
    "altitude": "alt",
    "hostname": "hname",
    "port": "prt",
}

DEFAULT_REVERSE = {short: long for long, short in DEFAULT_DICTIONARY.items()}
UNSAFE_KEYS = frozenset({"__proto__", "constructor", "prototype"})

#: Own wire tokens. Pass another delete sentinel to the delta functions to exchange
#: patches with a system that uses one of its own.
RESERVED_PREFIX = "__sealframe__"
DELETE_SENTINEL = RESERVED_PREFIX + ":delete"
PRIVACY_META_KEY = "__sealframe_privacy_meta"
ERROR_PREFIX = "sealframe: "
