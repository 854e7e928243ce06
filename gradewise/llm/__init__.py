"""Training-data operators: token files, packing, fingerprints, near
duplicates, language-model scores, decontamination, language, licences,
sharding and toxicity. Nothing outside this subpackage imports it."""
