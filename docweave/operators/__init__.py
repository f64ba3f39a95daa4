"""docweave.operators"""
