"""Stand-ins for a text model.  Their answer depends on every character."""


def _define():
    # Nested, so that workers get the functions themselves and need no copy of
    # this module.
    import hashlib

    def answer(text):
        return hashlib.md5(text.encode()).hexdigest()

    def digest_model():
        return lambda batch: [answer(text) for text in batch]

    def picky_model():
        """Cannot take a text with a bar in it."""

        def checked(text):
            if "|" in text:
                raise ValueError("bar in text")
            return answer(text)

        return lambda batch: [checked(text) for text in batch]

    def token_model():
        """Says the prompt again, then 1 to 32 hexadecimal digits, one by one."""

        def tokens(text):
            yield text
            yield from answer(text)[:1 + len(text) % 32]

        return lambda batch: [tokens(text) for text in batch]

    return digest_model, picky_model, token_model


digest_model, picky_model, token_model = _define()
