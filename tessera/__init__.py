"""tessera: document question-answering analytics expressed as DataFrame programs."""
