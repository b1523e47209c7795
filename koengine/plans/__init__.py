"""koengine.plans"""
