"""Web addresses: building, checking and normalising.

Variables of lambdas begin with two underscores: an argument may be a column of any ordinary name."""

from __future__ import annotations

from creatorlake.constants import SITE_URL, URL_MAX_LENGTH
from creatorlake.functions.hosts import normalize_host
from creatorlake.functions.sql import matches, text_literal

# scheme : slashes authority path query fragment
_PARTS = r"(?is)\A(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"
_HOST_PORT = r"(?s)\A(\[[^\]]*\]|[^:]*)(?::([0-9]*))?\z"
_PATH_UNSAFE = r"[\x00-\x20\"#<>?`{}\x7f]|[^\x00-\x7f]"
_QUERY_UNSAFE = r"[\x00-\x20\"#<>\x27\x7f]|[^\x00-\x7f]"
_FRAGMENT_UNSAFE = r"[\x00-\x20\"<>`\x7f]|[^\x00-\x7f]"
_ONE_DOT = r"(?i)\A(\.|%2e)\z"
_TWO_DOTS = r"(?i)\A(\.|%2e){2}\z"
_DOT_SEGMENT = r"(?i)(\A|/)(\.|%2e){1,2}(/|\z)"


def at_name(username: str) -> str:
    return f"if(startswith({username}, '@'), {username}, concat('@', {username}))"


def profile_url(username: str) -> str:
    return f"concat('{SITE_URL}', {at_name(username)})"


def plain_profile_url(username: str) -> str:
    """The form stored with a found profile: always one more ``@``."""
    return f"concat('{SITE_URL}@', {username})"


def video_url(username: str, post_id: str) -> str:
    return f"concat('{SITE_URL}', {at_name(username)}, '/video/', {post_id})"


def _part(s: str, pattern: str, group: int) -> str:
    return f"regexp_extract({s}, {text_literal(pattern)}, {group})"


def _without(s: str, pattern: str) -> str:
    return f"regexp_replace({s}, {text_literal(pattern)}, '')"


def _percent_encode(s: str, unsafe: str) -> str:
    return f"""if({matches(s, unsafe)}, array_join(transform(split({s}, ''),
        __c -> CASE WHEN __c = ' ' THEN '%20' WHEN {matches('__c', unsafe)} THEN url_encode(__c) ELSE __c END), ''), {s})"""


def _drop_dot_segments(path: str) -> str:
    """``.`` vanishes, ``..`` also takes the segment before it; at the end both leave a slash."""
    segments = f"split({_without(path, chr(92) + 'A/')}, '/')"
    last = f"element_at({segments}, -1)"
    kept = f"""aggregate({segments}, CAST(array() AS ARRAY<STRING>), (__done, __s) -> CASE
        WHEN {matches('__s', _TWO_DOTS)} THEN slice(__done, 1, greatest(size(__done) - 1, 0))
        WHEN {matches('__s', _ONE_DOT)} THEN __done ELSE array_append(__done, __s) END)"""
    open_end = f"({matches(last, _ONE_DOT)} OR {matches(last, _TWO_DOTS)})"
    resolved = f"concat('/', array_join(if({open_end}, array_append({kept}, ''), {kept}), '/'))"
    return f"if({matches(path, _DOT_SEGMENT)}, {resolved}, {path})"


def normalize_url(s: str) -> str:
    """http or https address in normal form, or NULL. Never rejects a record.

    Lower-case scheme, host in normal form (see ``hosts``), default port dropped, ``/`` for an empty path,
    unsafe characters percent-encoded, dot segments resolved."""
    bare = _without(_without(s, r"\A[\x00-\x20]+|[\x00-\x20]+\z"), r"[\t\n\r]")
    authority = _part(bare, _PARTS, 2)
    host_port = _without(authority, r"(?s)\A.*@")
    return f"""get(transform(
      transform(
        filter(array(named_struct(
          'scheme', lower({_part(bare, _PARTS, 1)}),
          'user', regexp_extract({authority}, r'(?s)\\A(.*)@', 1),
          'host', {normalize_host(_part(host_port, _HOST_PORT, 1))},
          'port', {_part(host_port, _HOST_PORT, 2)},
          'path', replace({_part(bare, _PARTS, 3)}, r'\\', '/'),
          'query', {_part(bare, _PARTS, 4)},
          'fragment', {_part(bare, _PARTS, 5)})),
          __u -> length({s}) <= {URL_MAX_LENGTH}
            AND {matches(bare, _PARTS)} AND {matches(host_port, _HOST_PORT)}
            AND __u.host IS NOT NULL
            AND (__u.port = '' OR coalesce(try_cast(__u.port AS INT), 65536) <= 65535)),
        __u -> named_struct('u', __u, 'port', try_cast(__u.port AS INT),
                          'path', if(__u.path = '', '/', {_drop_dot_segments('__u.path')}))),
      __p -> concat(
        __p.u.scheme, '://',
        if(__p.u.user = '', '', concat(replace(__p.u.user, '@', '%40'), '@')),
        __p.u.host,
        if(__p.port IS NULL OR __p.port = if(__p.u.scheme = 'http', 80, 443), '', concat(':', __p.port)),
        {_percent_encode('__p.path', _PATH_UNSAFE)},
        {_percent_encode('__p.u.query', _QUERY_UNSAFE)},
        {_percent_encode('__p.u.fragment', _FRAGMENT_UNSAFE)})), 0)"""
