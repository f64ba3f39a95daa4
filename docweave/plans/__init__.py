"""docweave.plans"""
