"""Column → Column functions (native expressions; no Python UDF)."""

from .dates import (epoch_default, iso_utc, month_key, parse_date,  # noqa: F401
                    parse_date_or_epoch, parse_date_text, rfc1123)
from .html import (clean_summary, decode_entities, html_to_markdown,  # noqa: F401
                   markdown_to_html, normalize_html, page_title, text_or_html_to_markdown)
from .keys import (entry_key, feed_key, partition_key_from_title, post_key,  # noqa: F401
                   xxh64_hex)
from .links import ascii_host, punycode, resolve_url  # noqa: F401
from .markdown import markdown_document_to_html  # noqa: F401
from .markup import page_to_markdown  # noqa: F401
from .npy import array_to_npy, npy_to_array  # noqa: F401
from .scores import engagement_score, str_to_bool  # noqa: F401
from .structured import (embedding_to_json, full_content, image_from_json,  # noqa: F401
                         image_to_json, json_path, parse_sentiment_reply,
                         parse_summary_reply, tags_to_terms)
from .text import (chat_messages, first_line, format_summary, preview,  # noqa: F401
                   readability, readability_cents, render_prompt, sentences,
                   sentinel_to_null, truncate_by_sentences, truncate_markdown,
                   word_count)
from .urls import is_http_url, normalize_link, normalize_url  # noqa: F401
