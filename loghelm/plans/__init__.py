"""Composed questions: projection, search, detail, timeline."""
