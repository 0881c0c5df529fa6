"""Sources and sinks: annotation documents, JSON lines, tables, spreadsheets, vocabularies."""

from hirameki.sources.readers import *  # noqa: F403
from hirameki.sources.writers import *  # noqa: F403
