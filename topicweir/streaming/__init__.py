"""Classification of decks as they arrive."""
