"""Deterministic document packets and privacy preprocessing on Spark."""

from .functions.codec import compress_text, decompress_text, reduction_ratio
from .functions.dedupe import dedupe_structures, expand_refs
from .functions.delta import apply_delta, diff_documents
from .functions.jsontext import canonical_text
from .functions.limits import PacketError, assert_safe_key, byte_size, deep_equal, validate_document
from .functions.normalize import normalize_types
from .functions.packet import assert_supported_version, create_packet, packet_fault, packet_hash, replay_packet, verify_packet
from .functions.shape import canonicalize, compact_schema, expand_schema, safe_entries, sort_record_keys, stable_sort_strings, validate_dictionary
from .privacy.detect import category_map, detect, field_category, residual_pattern_scan
from .privacy.policy import PrivacyError, assert_supported_report, format_path, parse_policy_path, path_matches, validate_policy
from .privacy.protect import assert_no_unhandled, create_private_packet, create_report, protect, verify_result

__version__ = "0.1.0"
