"""Marks of a cut and prompts to read on, by language, and words that only sentences of unspaced scripts use."""

MARKS = ["…", "...", "[…]", "[...]", "(…)", "(...)"]

NOTES = ["[content truncated]", "(truncated)", "[truncated]"]

PROMPTS = [
    "Continue reading →", "Continue reading", "Read more", "Read more →", "Sign in to read the full story", "Show more", "Weiterlesen", "Mehr lesen", "Lire la suite",
    "Seguir leyendo", "Leer más", "Читать далее", "阅读全文", "查看更多", "続きを読む", "もっと見る",
]

SENTENCE_CHARS = "的在了却就把与很为如经约这被，はがをにでとのもだすた"
